"""Rate limits in windows that begin with a client's first request.

A window begins with a request that no window of its client covers, and lasts ``width``; the next one begins with the first
request after its end. Where a client was silent for ``width`` a window begins whatever came before, so such requests are
known at once. From each of them the windows follow as a chain: every request points to the first one ``width`` or more later,
and marks spread along these pointers by doubling: in round k the pointers reach 2^k windows ahead, so the number of rounds is
the logarithm of the longest unbroken series of windows, and no loop runs over requests.

Clients are cut into slices of time. What a request's pointer needs lies less than two widths ahead, and what tells
silence less than one width back, so requests near a slice's end are also dealt to the next one, and those near its start
to the one before; a client with a third of all requests is no single task's work.

Defined cases: null clients are one client; requests of one moment are ordered by id, and null times are in no window (left out);
repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SLICE = 64  # widths in a slice


def _pointers(moments: DataFrame, width: int) -> DataFrame:
    """(client, t) distinct -> client, t, opens (silence of a width before), next (first moment a width later, if less than two)."""
    length = SLICE * width
    own = F.floor(F.col("t") / length).cast("long")
    near = F.array_distinct(F.array(own, F.floor((F.col("t") - 2 * width) / length).cast("long"), F.floor((F.col("t") + width) / length).cast("long")))
    dealt = moments.withColumn("slice", F.explode(near))
    before = Window.partitionBy("client", "slice").orderBy("t")
    silent = dealt.withColumn("gap", F.col("t") - F.lag("t").over(before))
    # a moment and the end of the window that it would begin, latest first, moments before ends of the same time
    points = silent.withColumn("p", F.explode(F.array(F.struct(F.col("t").alias("u"), F.lit(0).alias("is_end")), F.struct((F.col("t") + width).alias("u"), F.lit(1).alias("is_end")))))
    back = Window.partitionBy("client", "slice").orderBy(F.desc("p.u"), "p.is_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    followed = points.withColumn("next", F.last(F.when(F.col("p.is_end") == 0, F.col("p.u")), ignorenulls=True).over(back)).filter(F.col("p.is_end") == 1)
    mine = followed.filter(F.col("slice") == own)
    return mine.select("client", "t", (F.col("gap").isNull() | (F.col("gap") >= width)).alias("opens"), F.when(F.col("next") < F.col("t") + 2 * width, F.col("next")).alias("next"))


def window_starts(moments: DataFrame, width: int) -> DataFrame:
    """(client, t) distinct, in microseconds -> (client, t) of the moments with which windows begin."""
    pointers = written(_pointers(moments, width), "window-pointers")
    marked = written(pointers.filter("opens").select("client", "t"), "window-marks")
    n = marked.count()
    jump = pointers.filter("next IS NOT NULL").select("client", "t", "next")
    while True:
        ahead = marked.join(jump, (marked["client"].eqNullSafe(jump["client"])) & (marked["t"] == jump["t"])).select(marked["client"], jump["next"].alias("t"))
        marked = written(marked.union(ahead).distinct(), "window-marks")
        more = marked.count()
        if more == n:
            return marked
        n = more
        further = jump.select(F.col("client").alias("c_"), F.col("t").alias("t_"), F.col("next").alias("further"))
        jump = written(jump.join(further, F.col("client").eqNullSafe(F.col("c_")) & (F.col("next") == F.col("t_"))).select("client", "t", F.col("further").alias("next")), "window-jumps")


def first_request_windows(requests: DataFrame, client_col: str, seconds: int, most: int, time_col: str = "created", id_col: str = "id") -> DataFrame:
    """id, client, window_start, nth (place in the window), limited (over ``most``) of each request."""
    width = seconds * 1_000_000
    rows = requests.select(F.col(id_col).alias("id"), F.col(client_col).alias("client"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("t")).filter("t IS NOT NULL")
    starts = window_starts(rows.select("client", "t").distinct(), width)
    # a request's window began less than a width ago: in its own stretch of a width, or the one before
    stretch = lambda c: F.floor(c / width).cast("long")
    begun = starts.select(F.col("client").alias("c_"), F.col("t").alias("start"), F.explode(F.array(stretch(F.col("t")), stretch(F.col("t")) + 1)).alias("s_"))
    found = rows.withColumn("stretch", stretch(F.col("t"))).join(begun, F.col("client").eqNullSafe(F.col("c_")) & (F.col("stretch") == F.col("s_")))
    inside = found.filter((F.col("start") <= F.col("t")) & (F.col("t") < F.col("start") + width))
    nth = F.row_number().over(Window.partitionBy("client", "start").orderBy("t", "id"))
    return inside.select("id", F.col("client").alias(client_col), F.timestamp_micros("start").cast("timestamp_ntz").alias("window_start"), nth.cast("long").alias("nth"), (nth > most).alias("limited"))
