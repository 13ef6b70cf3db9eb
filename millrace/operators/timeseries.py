"""Ordered telemetry operators: latest per key, tails, retention, EMA, stock ledger.

Scale notes
-----------
* ``latest_per_key`` is a ``max_by`` aggregate: partial aggregation before the
  shuffle, so one machine holding a third of the rows costs one small partial
  result per input partition, not a sort of all its rows.
* ``tail_per_key`` relies on the window-group-limit rewrite
  (``row_number() <= n`` is evaluated per input partition before the shuffle).
* ``tail_n`` is a top-N for a stated small N; a number of rows that grows with
  the data (``newest``) is cut by counts of time instead (``selection``).
* ``ema_smooth`` is an exact sequential fold inside pieces of equal row count
  and an affine-map composition across pieces, so a hot key or a burst is spread
  over many tasks.
* ``stock_ledger`` streams one row per part-day (pre-aggregated) through one
  sorted pass; days without demand are folded in closed form.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import half_up
from millrace.operators import selection as S
from millrace.operators.pieces import PIECE_ROWS, sorted_pieces
from millrace.session import store

# ------------------------------------------------------------------ W1 / W5


def latest_per_key(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The newest row per key (ties broken by the later order columns)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order_cols]))
    return (df.groupBy(*keys).agg(picked.alias("_latest"))
              .select(*keys, *[F.col("_latest")[c].alias(c) for c in rest]))


# ------------------------------------------------------------------ W2 / W4


def tail_n(df: DataFrame, n: int, order_cols: Sequence[str], rank_col: str | None = None) -> DataFrame:
    """The ``n`` newest rows by ``order_cols`` (descending).

    For a stated, small ``n`` (a report's size): a top-N that keeps n rows per
    input partition. A number of rows that grows with the data goes through
    ``newest``, which never gathers them.
    """
    order = [F.col(c).desc() for c in order_cols]
    out = df.orderBy(*order).limit(n)
    if rank_col:
        out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    return out


def _newest(rows: DataFrame, cut: DataFrame, order_cols: Sequence[str], digits: list[str], columns: list[str]) -> DataFrame:
    taken = S.first_rows(rows, digits, cut, descending=True)
    group = S.spread(F.col("_wanted").isNull(), *order_cols)
    w = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order_cols])
    ranked = taken.withColumn("_rn", F.when(F.col("_wanted").isNotNull(), F.row_number().over(w)))
    return ranked.where(F.col("_wanted").isNull() | (F.col("_rn") <= F.col("_wanted"))).select(*columns)


def newest(df: DataFrame, n: int | Column, order_cols: Sequence[str]) -> DataFrame:
    """The newest ``n`` rows by ``order_cols``, the first of which is a time; rows without a time come last.

    Two counts, by 19 hours and by 66 milliseconds, find the n-th row's place
    (see ``selection``); only the rows of those milliseconds are ranked. Three
    passes over the rows, whatever n is, and nothing runs before the result is
    used.
    """
    d0, d1 = S.time_digits(F.col(order_cols[0]))
    rows = df.select("*", d0.alias("_d0"), d1.alias("_d1"))
    counts = rows.groupBy("_d0").agg(F.count(F.lit(1)).alias("_c"))
    goal = (F.lit(n) if isinstance(n, int) else n).cast("long")
    return _newest(rows, S.cut(counts, ["_d0"], goal, descending=True), order_cols, ["_d0", "_d1"], df.columns)


def rolling_retention(df: DataFrame, key: str, order_cols: Sequence[str], per_key: int = 10) -> DataFrame:
    """Keep the newest ``per_key`` x (number of distinct keys) rows.

    The pass that counts rows by time also counts the keys: it counts per (key,
    time), and the first time of a key stands for the key.
    """
    d0, d1 = S.time_digits(F.col(order_cols[0]))
    rows = df.select("*", d0.alias("_d0"), d1.alias("_d1"))
    per = rows.groupBy(key, "_d0").agg(F.count(F.lit(1)).alias("_n"))
    once = (F.row_number().over(Window.partitionBy(key).orderBy("_d0")) == 1) & F.col(key).isNotNull()
    counts = per.withColumn("_once", once.cast("long")).groupBy("_d0").agg(F.sum("_n").alias("_c"), F.sum("_once").alias("_keys"))
    counts = counts.withColumn("_goal", F.sum("_keys").over(Window.partitionBy()) * per_key)
    return _newest(rows, S.cut(counts, ["_d0"], F.col("_goal"), descending=True), order_cols, ["_d0", "_d1"], df.columns)


# ---------------------------------------------------------------------- W3


def tail_per_key(df: DataFrame, key: str, order_cols: Sequence[str], n: int,
                 pos_col: str | None = None) -> DataFrame:
    """The ``n`` newest rows of every key.

    ``pos_col`` adds the row's 0-based position in the key's whole series
    (oldest = 0). The series length comes from a partially aggregated count
    joined back to the (small) tail, not from a window over the whole key.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_cols])
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if pos_col:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_cnt"))
        out = (out.join(counts, key, "inner")
                  .withColumn(pos_col, (F.col("_cnt") - F.col("_rn")).cast("int"))
                  .drop("_cnt"))
    return out.drop("_rn")


def sequence_ids(df: DataFrame, order_cols: Sequence[str], fmt: str = "M-%05d",
                 id_col: str = "Seq_ID", groups: int = 1) -> DataFrame:
    """Running, zero-padded ids in a global ascending order.

    Rows are numbered inside their group (the first ``groups`` order columns);
    the running total of the group sizes is added. Only the list of groups is
    ordered in one task.
    """
    lead, rest = list(order_cols[:groups]), list(order_cols[groups:])
    sizes = df.groupBy(*lead).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in lead],
                           F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    same = [df[c].eqNullSafe(F.col(f"_g_{c}")) for c in lead]
    on = same[0]
    for s in same[1:]:
        on = on & s
    number = F.row_number().over(Window.partitionBy(*lead).orderBy(*(rest or lead))) + F.col("_before")
    return df.join(offsets, on).withColumn(id_col, F.format_string(fmt, number)).select(*df.columns, id_col)


# ---------------------------------------------------------------------- W6

EMA_ALPHA = 0.15  # fixed value: smoothing factor of the live feed


def _replay_partitions(batches, key: str, value_cols: list[str], alpha: float):
    """Sequential s <- s + alpha * (x - s) over rows sorted by (key, chunk, order).

    Every chunk starts from its entry state (``_in_<col>``); the running state
    is carried across Arrow batches because a chunk may span two batches.
    NULL readings keep the state.
    """
    last_id = None
    state: dict[str, float] = {}
    for pdf in batches:
        if pdf.empty:
            continue
        k = pdf[key].to_numpy()
        ch = pdf["_chunk"].to_numpy()
        starts = np.ones(len(pdf), dtype=bool)
        starts[1:] = (k[1:] != k[:-1]) | (ch[1:] != ch[:-1])
        if last_id == (k[0], ch[0]):
            starts[0] = False          # the chunk continues from the previous batch
        start = starts.tolist()
        for c in value_cols:
            xs = pdf[c].to_numpy(dtype="float64", na_value=np.nan).tolist()
            ins = pdf[f"_in_{c}"].to_numpy(dtype="float64", na_value=np.nan).tolist()
            s = state.get(c, float("nan"))
            out = [0.0] * len(xs)
            for i, v in enumerate(xs):
                if start[i]:
                    s = ins[i]
                if v == v:
                    s = s + alpha * (v - s)
                out[i] = s
            state[c] = s
            pdf[c] = out
        last_id = (k[-1], ch[-1])
        yield pdf


# Kinds of rows in a sorted series: where it starts, its readings, and what a piece hands on
START_ROW, READING, OPEN_MAP, CLOSING = 0, 1, 2, 3


def _keys(column: pd.Series) -> list:
    return [None if k != k else k for k in column.tolist()]


def _fold_pieces(batches, key: str, value_cols: list[str], alpha: float):
    """One pass over a piece: states of the keys that start in it, and what it hands on.

    Rows are sorted by (key, kind, order); a key starts with a row of its starting
    state. The first key of the piece is open if it has no such row here: its
    rows go out as they came (``_open``), and an ``OPEN_MAP`` row tells what they
    do to the state s they start from, s -> (1 - alpha)^m s + b. The state at
    the end of the last key, if it is not the open one, goes out as ``CLOSING``.
    """
    cur, opened, form = None, None, None
    state = dict.fromkeys(value_cols, 0.0)
    count = dict.fromkeys(value_cols, 0)

    def handed_on(kind: int) -> pd.DataFrame:
        out = form.copy()
        out[key], out["_kind"], out["_open"] = [cur], kind, False
        for c in value_cols:
            out[c] = state[c]
        out["_m"] = [[float(count[c]) for c in value_cols]]
        return out

    for pdf in batches:
        if pdf.empty:
            continue
        form = pdf.iloc[:1]
        keys, kinds = _keys(pdf[key]), pdf["_kind"].tolist()
        if opened is None:
            opened, cur = kinds[0] != START_ROW, keys[0] if kinds[0] != START_ROW else object()
        if opened:
            n = next((i for i, k in enumerate(keys) if k != cur), len(keys))
            for c in value_cols:
                s, xs = state[c], [v for v in pdf[c].to_numpy(dtype="float64", na_value=np.nan)[:n].tolist() if v == v]
                for v in xs:
                    s = s + alpha * (v - s)
                state[c], count[c] = s, count[c] + len(xs)
            yield pdf.iloc[:n].assign(_open=True, _m=None)
            if n == len(keys):
                continue
            yield handed_on(OPEN_MAP)
            opened, cur, pdf, keys, kinds = False, object(), pdf.iloc[n:], keys[n:], kinds[n:]
        begin = [k != before for k, before in zip(keys, [cur, *keys])]
        smoothed = {}
        for c in value_cols:
            s, out = state[c], []
            for new, kind, v in zip(begin, kinds, pdf[c].to_numpy(dtype="float64", na_value=np.nan).tolist()):
                if kind == START_ROW:
                    s = v
                else:
                    if new:
                        s = math.nan  # a key without a starting state
                    if v == v:
                        s = s + alpha * (v - s)
                out.append(s)
            state[c], smoothed[c] = s, out
        cur = keys[-1]
        yield pdf.assign(**smoothed, _open=False, _m=None)[pdf["_kind"].to_numpy() == READING]
    if form is not None:
        yield handed_on(OPEN_MAP if opened else CLOSING)


def _chain_pieces(batches, key: str, value_cols: list[str], one_minus_alpha: float):
    """Entry state of every open key: the handed-on states and maps of a key, composed in piece order."""
    cur, state, begun = None, None, False
    for pdf in batches:
        rows = []
        for k, piece, kind, m, values in zip(_keys(pdf[key]), pdf["_piece"].tolist(), pdf["_kind"].tolist(), pdf["_m"].tolist(),
                                             pdf[value_cols].to_numpy(dtype="float64", na_value=np.nan)):
            if not begun or k != cur:
                cur, begun, state = k, True, np.full(len(value_cols), np.nan)
            if kind == OPEN_MAP:
                rows.append((piece, *state))
                state = one_minus_alpha ** np.asarray(m) * state + values
            else:
                state = values
        yield pd.DataFrame(rows, columns=["_chunk", *[f"_in_{c}" for c in value_cols]])


def ema_smooth(df: DataFrame, key: str, ts_col: str, tie_cols: Sequence[str],
               value_cols: Sequence[str], init: DataFrame, alpha: float = EMA_ALPHA,
               chunk_rows: int = PIECE_ROWS, places: bool = False) -> DataFrame:
    """Per-key exponential smoothing of ``value_cols`` ordered by time.

    ``init`` has ``key`` and one column per value column holding the starting
    state. Returns ``df``'s rows with the value columns (as doubles) replaced by
    the unrounded smoothed state after each row. Rows without a time come first;
    rows of one time go in the order of the tie columns. ``places`` adds
    ``_piece`` and ``_seq``, by which the rows can be put in that order again.

    The rows and the starting states are sorted together into pieces of about
    ``chunk_rows`` rows (``pieces``), which one streamed pass folds and stores: a
    key that starts in its piece is done there. Of a key that goes on from the
    piece before, the pass hands on the affine map that its rows apply to the
    state (one small row a piece); the maps are composed in order, and only the
    rows of such keys are folded again, from their entry states. So a key with a
    third of all rows, in whatever time they lie, is worked on by many tasks.
    Counts and sorts the rows when it is called.
    """
    cols = list(value_cols)
    values = [F.col(c).cast("double").alias(c) for c in cols]
    rest = [c for c in df.columns if c not in cols]
    readings = df.select(*rest, *values, F.lit(READING).alias("_kind"))
    starts = init.select(F.col(key).cast(df.schema[key].dataType).alias(key), *values, F.lit(START_ROW).alias("_kind"))
    series = readings.unionByName(starts, allowMissingColumns=True)
    pieces = sorted_pieces(series, key, ["_kind", ts_col, *tie_cols], chunk_rows)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pieces.schema]
                          + [T.StructField("_open", T.BooleanType()), T.StructField("_m", T.ArrayType(T.DoubleType()))])
    folded = store(pieces.mapInPandas(lambda it: _fold_pieces(it, key, cols, alpha), schema), "smoothed")

    entry_schema = T.StructType([T.StructField("_chunk", T.IntegerType())] + [T.StructField(f"_in_{c}", T.DoubleType()) for c in cols])
    one = 1.0 - alpha
    entries = (folded.where(F.col("_kind") > READING).select(key, "_piece", "_kind", "_m", *cols)
               .repartition(key).sortWithinPartitions(key, "_piece", F.col("_kind").asc())
               .mapInPandas(lambda it: _chain_pieces(it, key, cols, one), entry_schema))
    still = folded.where("_open").drop("_m").withColumn("_chunk", F.col("_piece")).join(entries, "_chunk")
    replayed = (still.repartition("_chunk").sortWithinPartitions("_chunk", "_seq")
                .mapInPandas(lambda it: _replay_partitions(it, key, cols, alpha), still.schema))
    done = folded.where((F.col("_kind") == READING) & ~F.col("_open"))
    columns = [*df.columns, *(["_piece", "_seq"] if places else [])]
    return done.select(*columns).unionByName(replayed.select(*columns))


# ---------------------------------------------------------------------- W9

LEDGER_COLUMNS = ["Day", "Need", "Opening_Stock", "Consumed", "Shortage", "Refilled", "Closing_Stock", "Until_Day"]


def _fold_ledger(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """One pass over rows sorted by (key, day); each key ends with a row of Need NULL on day N."""
    current, stock, day, rows = None, 0, 0, []

    def add(d: int, need: int, opening: int, consumed: int, refilled: bool, closing: int) -> None:
        rows.append([current, d, need, opening, consumed, need > opening, refilled, closing, 0])

    for pdf in batches:
        out_rows = []
        for k, d, need, opening, safety, refill in zip(*(pdf[c].tolist() for c in
                                                         (key, "_day", "Need", "Opening_Stock", "Safety_Stock", "Refill"))):
            if k != current:
                current, stock, day = k, int(opening), 0
            # quiet days: refilled while below the safety stock; the first day is always a row
            while day < d and stock < safety:
                add(day, 0, stock, 0, True, stock + int(refill))
                stock += int(refill)
                day += 1
            if day < d and day == 0:
                add(0, 0, stock, 0, False, stock)
            day = d
            if need != need or need is None:
                for i, r in enumerate(rows):
                    r[8] = (rows[i + 1][1] if i + 1 < len(rows) else d) - 1
                out_rows += rows
                rows = []
            else:
                consumed = min(int(need), stock)
                after = stock - consumed
                refilled = after < safety
                closing = after + (int(refill) if refilled else 0)
                add(d, int(need), stock, consumed, refilled, closing)
                stock, day = closing, d + 1
        yield pd.DataFrame(out_rows, columns=[key, *LEDGER_COLUMNS])


def stock_ledger(demand: DataFrame, stock: DataFrame, key: str = "Part_Key") -> DataFrame:
    """Per-part, time-ordered stock ledger over all production days.

    ``demand``: (key, Date, Need) with one row per part-day (sum needs first;
    within a day end stock = max(0, s - sum(need)) and a shortage happens iff
    sum(need) > s, for positive needs). ``stock``: (key, Opening_Stock,
    Safety_Stock, Refill), one row per part. Each production day (a day on which
    any part has demand): consume min(need, stock), flag a shortage when
    stock < need; at the end of the day add the part's refill when its stock is
    below the safety stock. Also parts without demand that day are refilled.

    A row stands for the part's first production day, each day with demand and
    each day with a refill; ``Until_Date`` is the last production day on which
    its closing stock holds, so the rows give the stock of every part-day.
    Rows are streamed sorted by part and day; a part has at most a calendar of
    them, and its quiet days cost one step per refill.
    """
    days = demand.select("Date").distinct()
    calendar = days.select("Date", (F.row_number().over(Window.orderBy("Date")) - 1).cast("int").alias("_day"))
    size = calendar.agg(F.count(F.lit(1)).cast("int")).scalar()
    rows = demand.join(calendar, "Date").select(key, "_day", F.col("Need").cast("double").alias("Need"))
    ends = stock.select(key, size.alias("_day"), F.lit(None).cast("double").alias("Need"))
    events = rows.unionByName(ends).join(stock, key, "inner")
    kind = stock.schema[key].dataType.simpleString()
    folded = (events.repartition(key).sortWithinPartitions(key, "_day")
              .mapInPandas(lambda it: _fold_ledger(it, key),
                           f"`{key}` {kind}, Day int, Need bigint, Opening_Stock bigint, Consumed bigint, "
                           "Shortage boolean, Refilled boolean, Closing_Stock bigint, Until_Day int"))
    until = calendar.select(F.col("Date").alias("Until_Date"), F.col("_day").alias("Until_Day"))
    return (folded.join(calendar.withColumnRenamed("_day", "Day"), "Day").join(until, "Until_Day")
            .select(key, "Date", "Need", "Opening_Stock", "Consumed", "Shortage", "Refilled", "Closing_Stock", "Until_Date"))


def ema_rounding(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Round smoothed values half-up per sensor (e.g. vibration 3, RPM 0)."""
    out = df
    for c, n in decimals.items():
        out = out.withColumn(c, F.when(F.col(c) >= 0, half_up(c, n))
                             .otherwise(-half_up(-F.col(c), n)))
    return out
