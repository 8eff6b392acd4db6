"""Similar labelled training rows for every row: categorical prefix match, then cosine top-n.

Shape of the job
----------------
1. Prefix counts come from one rollup over *distinct* category combinations; the longest prefix with
   more than n training rows is a row's candidate group. Only groups some row chose are kept.
2. Rows with the same group and the same unit vector have the same neighbours, so search runs on
   distinct points. On the training side at most n + 1 rows per (group, class, vector) can ever be
   picked, so further copies are pruned before the search shuffle. Copies cost nothing, however many.
3. Groups above ``CELL_ROWS`` are tiled: each pass cuts every big cell into slices of equal row count
   along the next coordinate, until cells are small. A point first searches its home cell, which
   bounds its n-th similarity; then it visits only the cells that its ball can reach. In many
   dimensions single coordinates tell vectors apart badly, so cells are cones around pivots there, and
   pairs in a cell are bounded before they are summed (:mod:`cones`). Vectors of two coordinates lie on a
   circle, where a point compares with its neighbours by angle only (:mod:`circle`).
4. Cells (and chunks of points that share a cell) are packed into tasks that are even in points and
   training rows together; a task multiplies blocks with numpy and emits at most n + 1 candidates per
   point and class.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators import circle, cones
from corpusforge.operators.cleaning import category, number
from corpusforge.operators.joins import lookup_join
from corpusforge.operators.quantiles import bracket_columns, order_values
from corpusforge.operators.ranking import hash_ranked, seeded_hash
from corpusforge.session import materialize
from corpusforge.spec import BINARY, MULTICLASS, TableSpec

CELL_ROWS = 8_192
POINT_CHUNK = 8_192
SLICES = 32
SCORE_BLOCK = 2_000_000
PACK_ROWS = 65_536
#: A point with more rows than this is crowded.
MANY_COPIES = 10_000
#: From so many coordinates on, cells are cones. There rows are wide and bounds may exclude nothing, so cells and
#: chunks are as large as a task holds, and a chunk of points has so many pairs with its cell at most.
CONE_DIMS, CONE_ROWS, CONE_PAIRS = 8, 65_536, 2_000_000_000


# ---------------------------------------------------------------- vectors and prefixes


def scale_params(train: DataFrame, cols) -> DataFrame:
    """One row ``<col>_mean, <col>_std``; a zero deviation reads 1.

    Parameters keep eleven significant digits, so the order in which partial sums were merged cannot
    change a ranking.
    """

    def steady(x: Column) -> Column:
        return F.format_string("%.10e", x).cast("double")

    aggs = []
    for c in cols:
        x = number(F.col(c))
        std = F.stddev_samp(x)
        aggs.append(F.when(F.count(x) > 0, steady(F.avg(x))).alias(f"{c}_mean"))
        aggs.append(F.when(std == 0, 1.0).when(std.isNotNull(), steady(std)).alias(f"{c}_std"))
    return train.agg(*aggs)


def unit_vectors(df: DataFrame, params: dict, cols) -> DataFrame:
    """Add ``vec``: standardised numeric features (missing ones at the mean), scaled to length one."""
    zs = []
    for c in cols:
        mean, std = params[f"{c}_mean"], params[f"{c}_std"]
        if mean is None or std is None:
            zs.append(F.lit(0.0))
            continue
        zs.append((F.coalesce(number(F.col(c)), F.lit(mean)) - F.lit(mean)) / F.lit(std))
    if not zs:
        return df.withColumn("vec", F.array().cast("array<double>"))
    named = df.withColumns({f"_z{i}": z for i, z in enumerate(zs)})
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(zs))]))
    scaled = named.withColumn("_norm", F.when(norm == 0, 1.0).otherwise(norm))
    units = [F.col(f"_z{i}") / F.col("_norm") for i in range(len(zs))]
    return scaled.withColumn("vec", F.array(*units)).drop("_norm", *[f"_z{i}" for i in range(len(zs))])


def prefix_counts(train: DataFrame, cats) -> DataFrame:
    """``c1..cK, depth, cnt`` for every category prefix; columns beyond the depth are NULL."""
    cats = list(cats)
    if not cats:
        return train.agg(F.lit(0).cast("bigint").alias("depth"), F.count(F.lit(1)).alias("cnt"))
    combos = train.groupBy(*[category(F.col(c)).alias(c) for c in cats]).agg(F.count(F.lit(1)).alias("_n"))
    rolled = combos.rollup(*cats).agg(F.sum("_n").alias("cnt"), F.bit_count(F.grouping_id()).alias("_g"))
    return rolled.select(*cats, (F.lit(len(cats)) - F.col("_g")).cast("bigint").alias("depth"), "cnt")


def _key(cats, depth: Column) -> Column:
    """Unambiguous text for the first ``depth`` categories."""
    if not cats:
        return F.lit("[]")
    return F.to_json(F.slice(F.array(*[F.col(c) for c in cats]), F.lit(1), depth.cast("int")))


def choose_prefix(query: DataFrame, train: DataFrame, cats, n: int) -> tuple[DataFrame, DataFrame]:
    """Per distinct combination: the group its rows search, and the groups its training rows belong to.

    Returns ``(c1..cK, group, depth)`` for query combinations and ``(c1..cK, groups)`` for training
    combinations, the latter limited to groups that some query combination chose.
    """
    cats = list(cats)
    big = prefix_counts(train, cats).filter((F.col("cnt") > n) & (F.col("depth") > 0))
    big = big.select(_key(cats, F.col("depth")).alias("group"), F.lit(True).alias("_big"))
    depths = F.explode(F.sequence(F.lit(1), F.lit(len(cats)))).alias("depth")

    def distinct(df):
        return df.select(*[category(F.col(c)).alias(c) for c in cats]).distinct()

    tried = distinct(query).select(*cats, depths).withColumn("group", _key(cats, F.col("depth")))
    tried = lookup_join(tried, big, ["group"])
    chosen = tried.groupBy(*cats).agg(F.coalesce(F.max(F.when(F.col("_big"), F.col("depth"))), F.lit(0)).alias("depth"))
    chosen = chosen.select(*cats, _key(cats, F.col("depth")).alias("group"), F.col("depth").cast("bigint").alias("depth"))
    used = chosen.select("group").distinct().withColumn("_used", F.lit(True))
    all_depths = F.explode(F.sequence(F.lit(0), F.lit(len(cats)))).alias("depth")
    owned = distinct(train).select(*cats, all_depths).withColumn("group", _key(cats, F.col("depth")))
    owned = lookup_join(owned, used, ["group"], "inner")
    return chosen, owned.groupBy(*cats).agg(F.collect_set("group").alias("groups"))


def match_groups(query: DataFrame, train: DataFrame, spec: TableSpec, n: int) -> tuple[DataFrame, DataFrame]:
    """Query rows with their ``group`` and ``depth``; training rows once per group they can serve."""
    cats = list(spec.match_cols)
    if not cats:
        one = F.lit("[]")
        return (
            query.withColumn("group", one).withColumn("depth", F.lit(0).cast("bigint")),
            train.withColumn("group", one),
        )
    query = query.withColumns({c: category(F.col(c)) for c in cats})
    train = train.withColumns({c: category(F.col(c)) for c in cats})
    chosen, owned = choose_prefix(query, train, cats, n)
    queries = lookup_join(query, chosen, cats, "inner")
    serving = lookup_join(train, owned, cats, "inner")
    return queries, serving.withColumn("group", F.explode("groups")).drop("groups")


# ---------------------------------------------------------------- classes for balancing


def _with_classes(
    queries: DataFrame, serving: DataFrame, spec: TableSpec, target: str, numeric: bool, exclude_self: bool, binarize
) -> tuple[DataFrame, DataFrame]:
    """Give training rows a class ``cls`` and both sides a ``lane`` (group plus how it is split in two).

    Multiclass tables use their labels. Two-class balancing takes ``binarize`` when the task has one,
    else the median of the row's own candidates (numbers) or the greater / most frequent label.
    Leaving out the row itself can move that split, so a group may need a few lanes.
    """
    if spec.task == MULTICLASS:
        labeled = serving.withColumn("cls", F.col(target).cast("string")).filter("cls is not null")
        return queries.withColumn("lane", F.col("group")), labeled.withColumn("lane", F.col("group"))
    if binarize is not None:
        labeled = serving.withColumn("cls", binarize(F.col(target)).cast("string"))
        return queries.withColumn("lane", F.col("group")), labeled.withColumn("lane", F.col("group"))

    own = F.col(target) if exclude_self else F.lit(None)
    if numeric:
        serving = materialize(serving.withColumn("_t", F.col(target).cast("double")))
        split = _median_splits(serving)
        queries = lookup_join(queries.withColumn("_own", own.cast("double")), split, ["group"])
        v, odd = F.col("_own"), F.col("n") % 2 == 1
        moved = (
            F.when(odd & (v < F.col("mid")), (F.col("mid") + F.col("high")) / 2)
            .when(odd & (v > F.col("mid")), (F.col("low") + F.col("mid")) / 2)
            .when(odd, (F.col("low") + F.col("high")) / 2)
            .when(v <= F.col("low"), F.col("mid"))
            .otherwise(F.col("low"))
        )
        plain = F.when(odd, F.col("mid")).otherwise((F.col("low") + F.col("mid")) / 2)
        queries = queries.withColumn("split", F.when(v.isNull() | (F.col("n") == 1), plain).otherwise(moved))
        queries = queries.drop("_own", "n", "low", "mid", "high")
        is_one = F.col("_t") > F.col("split")
    else:
        serving = materialize(serving.withColumn("_t", F.col(target).cast("string")))
        split = _label_splits(serving, exclude_self)
        queries = queries.withColumn("_own", F.coalesce(own.cast("string"), F.lit("")))
        queries = lookup_join(queries, split, ["group", "_own"]).drop("_own")
        is_one = F.col("_t") == F.col("split")
    queries = materialize(queries)
    lanes = queries.select("group", "split").distinct().groupBy("group").agg(F.collect_set("split").alias("splits"))
    labeled = lookup_join(serving, lanes, ["group"], "inner").withColumn("split", F.explode("splits"))
    labeled = labeled.withColumn("cls", F.when(is_one, "1").otherwise("0")).drop("splits", "_t")
    lane = F.to_json(F.struct("group", "split"))
    return queries.withColumn("lane", lane).drop("split"), labeled.withColumn("lane", lane).drop("split")


def _median_splits(serving: DataFrame) -> DataFrame:
    """``group, n, low, mid, high``: the target values around each group's middle.

    For odd n they are the middle value and its two neighbours; for even n ``low`` and ``mid`` are
    the two middle values.
    """
    by = ["group"]
    base = materialize(serving.groupBy(*by).agg(F.count("_t").alias("n"), *bracket_columns("_t", [0.5])))
    middle = F.floor(F.col("n") / 2)
    odd = F.col("n") % 2 == 1
    ranks = [middle - 1, middle, F.when(odd, middle + 1).otherwise(F.lit(-1))]
    found = order_values(serving, base, by, "_t", 1, ranks)
    return found.select("group", "n", F.col("r0").alias("low"), F.col("r1").alias("mid"), F.col("r2").alias("high"))


def _label_splits(serving: DataFrame, exclude_self: bool) -> DataFrame:
    """``group, _own, split``: which label counts as class 1 once a row with label ``_own`` is left out.

    With two labels left it is the greater one, otherwise the most frequent one (ties: smaller label).
    """
    counts = serving.groupBy("group", "_t").agg(F.count(F.lit(1)).alias("cnt"))
    # leaving out one row changes one count by one, so the three most frequent labels settle it
    order = Window.partitionBy("group").orderBy(F.col("cnt").desc(), "_t")
    leading = counts.withColumn("_r", F.row_number().over(order)).filter("_r <= 3")
    per = counts.groupBy("group").agg(F.count(F.lit(1)).alias("_k")).join(
        leading.groupBy("group").agg(F.collect_list(F.struct("_t", "cnt")).alias("_top")), "group"
    )
    cases = per.select("group", F.lit("").alias("_own"), F.lit(0).cast("bigint").alias("_own_cnt"), "_k", "_top")
    if exclude_self:
        owned = counts.select("group", F.col("_t").alias("_own"), F.col("cnt").alias("_own_cnt")).join(per, "group")
        cases = cases.unionByName(owned)
    less = F.transform(
        "_top", lambda e: F.struct((e["cnt"] - (e["_t"] == F.col("_own")).cast("bigint")).alias("c"), e["_t"].alias("t"))
    )
    left = F.filter(less, lambda e: e["c"] > 0)
    cases = cases.withColumn("_left", left).withColumn("_k", F.col("_k") - (F.col("_own_cnt") == 1).cast("int"))
    greatest = F.array_max(F.transform("_left", lambda e: e["t"]))
    frequent = F.array_min(F.transform("_left", lambda e: F.struct((-e["c"]).alias("c"), e["t"].alias("t"))))["t"]
    return cases.filter("_k > 0").select("group", "_own", F.when(F.col("_k") == 2, greatest).otherwise(frequent).alias("split"))


# ---------------------------------------------------------------- exact search


def _scalars(df: DataFrame, dims: int) -> DataFrame:
    return df.withColumns({f"u{i}": F.get("vec", F.lit(i)) for i in range(dims)}).drop("vec")


def _tile(train: DataFrame, dims: int, cell_rows: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Cut big cells into equal-count slices, one coordinate per pass.

    Returns the training rows with their leaf ``cell`` and, per pass, the coordinate and the table
    ``cell, edges`` of the cells cut in it. Slice s holds values in (edge s-1, edge s].
    """
    levels: list[tuple[int, DataFrame]] = []
    idle = 0
    while dims and idle < dims:
        coordinate = len(levels) % dims
        sizes = train.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))
        big = sizes.filter(F.col("_rows") > cell_rows).select("cell")
        if big.isEmpty():
            break
        u = f"u{coordinate}"
        marked = lookup_join(train, big.withColumn("_big", F.lit(True)), ["cell"])
        probs = [i / SLICES for i in range(1, SLICES)]
        edges = materialize(
            marked.filter("_big")
            .groupBy("cell")
            .agg(F.percentile_approx(u, probs, 1_000).alias("edges"))
            .select("cell", F.array_distinct("edges").alias("edges"))
        )
        cut = lookup_join(train, edges, ["cell"])
        train = materialize(cut.withColumn("cell", _slice_name(F.col(u))).drop("edges"))
        levels.append((coordinate, edges))
        widest = edges.agg(F.max(F.size("edges"))).first()[0]
        idle = idle + 1 if widest <= 1 else 0
    return train, levels


def _below(x: Column) -> Column:
    return F.size(F.filter("edges", lambda e: e < x))


def _slice_name(x: Column) -> Column:
    return F.when(F.col("edges").isNull(), F.col("cell")).otherwise(
        F.concat(F.col("cell"), F.lit("/"), _below(x).cast("string"))
    )


def _descend(points: DataFrame, levels, reach: Column | None = None) -> DataFrame:
    """Move points down the tiling: to their home cell, or to every cell within ``reach``."""
    for coordinate, edges in levels:
        u = F.col(f"u{coordinate}")
        points = lookup_join(points, edges, ["cell"])
        if reach is None:
            points = points.withColumn("cell", _slice_name(u)).drop("edges")
            continue
        slices = F.sequence(_below(u - reach), _below(u + reach))
        names = F.transform(slices, lambda s: F.concat(F.col("cell"), F.lit("/"), s.cast("string")))
        points = points.withColumn(
            "cell", F.explode(F.when(F.col("edges").isNull(), F.array("cell")).otherwise(names))
        ).drop("edges")
    return points


def _scorer(dims: int, with_point: bool = False):
    """Task body: for each cell in the pack, the best ``k`` training rows of every point.

    ``with_point`` adds what the point brought: its ``cell``, ``k`` and coordinates.
    """
    brought = [("cell", pa.string()), ("k", pa.int32()), *((f"u{i}", pa.float64()) for i in range(dims))] if with_point else []
    schema = pa.schema(
        [("pid", pa.int64()), ("cls", pa.string()), ("sims", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), *brought]
    )

    def matrix(table, rows):
        if dims == 0:
            return np.zeros((len(rows), 0))
        return np.column_stack([table.column(f"u{i}").to_numpy()[rows] for i in range(dims)])

    def best(q, t, ids, floor, k):
        """(point row, similarity, id) of the top k, by similarity then id; ``t`` is sorted by id."""
        if dims >= CONE_DIMS:
            return cones.best(q, t, ids, floor, k)[:3]
        if dims == 2:
            return circle.best(q, t, ids, floor, k, compare)
        return compare(q, t, ids, floor, k)

    def compare(q, t, ids, floor, k):
        out = []
        step = max(1, SCORE_BLOCK // max(1, len(ids)))
        for start in range(0, len(q), step):
            part = q[start : start + step]
            scores = np.ones((len(part), len(ids))) if dims == 0 else part[:, 0:1] * t[:, 0]
            for i in range(1, dims):
                scores += part[:, i : i + 1] * t[:, i]
            limit = floor[start : start + step, None]
            if len(ids) > k:
                kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
                limit = np.maximum(limit, kth)
            rows, cols = np.nonzero(scores >= limit)
            values = scores[rows, cols]
            order = np.lexsort((cols, -values, rows))
            rows, cols, values = rows[order], cols[order], values[order]
            first = np.searchsorted(rows, rows, side="left")
            keep = np.arange(len(rows)) - first < k
            out.append((rows[keep] + start, values[keep], ids[cols[keep]]))
        return [np.concatenate(x) for x in zip(*out)]

    def score(points: pa.Table, train: pa.Table) -> pa.Table:
        if points.num_rows == 0 or train.num_rows == 0:
            return schema.empty_table()
        both = pa.chunked_array(points.column("cell").chunks + train.column("cell").chunks).combine_chunks()
        codes = both.dictionary_encode().indices.to_numpy()
        p_codes, t_codes = codes[: points.num_rows], codes[points.num_rows :]
        t_ids = train.column("train_id").to_numpy()
        p_order = np.argsort(p_codes, kind="stable")
        t_order = np.lexsort((t_ids, t_codes))
        floors = points.column("floor").to_numpy()
        pids, labels = points.column("pid").to_numpy(), points.column("cls")
        found = []
        sorted_p, sorted_t = p_codes[p_order], t_codes[t_order]
        wanted = points.column("k").to_numpy()
        for code in np.unique(sorted_p):
            mine = p_order[slice(*np.searchsorted(sorted_p, [code, code + 1]))]
            theirs = t_order[slice(*np.searchsorted(sorted_t, [code, code + 1]))]
            if len(theirs) == 0:
                continue
            rows, sims, ids = best(matrix(points, mine), matrix(train, theirs), t_ids[theirs], floors[mine], wanted[mine[0]])
            found.append((mine[rows], sims, ids))
        if not found:
            return schema.empty_table()
        rows, sims, ids = [np.concatenate(x) for x in zip(*found)]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], dtype=int)
        offsets = pa.array(np.r_[starts, len(rows)].astype("int32"))
        heads = rows[starts]
        return pa.table(
            [
                pa.array(pids[heads]),
                labels.take(pa.array(heads)).combine_chunks(),
                pa.ListArray.from_arrays(offsets, pa.array(sims)),
                pa.ListArray.from_arrays(offsets, pa.array(ids)),
                *(points.column(c).take(pa.array(heads)).combine_chunks().cast(t) for c, t in brought),
            ],
            schema=schema,
        )

    return score


def packs_for(loads: DataFrame, least: int) -> int:
    """Number of tasks for cells with ``_points``, ``_rows`` and ``_chunks``: a chunk of points brings all
    training rows of its cell along, so both sides count."""
    both = F.col("_points") + F.col("_chunks") * F.col("_rows")
    return max(least, math.ceil((loads.agg(F.sum(both).alias("r")).first()["r"] or 0) / PACK_ROWS))


def _score(points: DataFrame, train: DataFrame, dims: int, with_point: bool = False) -> DataFrame:
    """Run the scorer over evenly packed cells; crowded cells are served in several chunks of points."""
    loads = points.groupBy("cell").agg(F.count(F.lit(1)).alias("_points"))
    served = train.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))
    chunk = F.lit(POINT_CHUNK)
    if dims >= CONE_DIMS:
        chunk = F.least(F.lit(CONE_ROWS), F.greatest(chunk, F.floor(CONE_PAIRS / F.col("_rows"))))
    chunks = F.ceil(F.col("_points") / chunk).cast("int")
    loads = materialize(loads.join(served, "cell").withColumn("_chunks", chunks))
    plan = loads.select("cell", "_chunks", (F.col("_points") / F.col("_chunks") + F.col("_rows") > PACK_ROWS // 4).alias("_alone"))
    packs = packs_for(loads, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [f"u{i}" for i in range(dims)]
    left = lookup_join(points, plan, ["cell"], "inner").withColumn("chunk", F.pmod(F.xxhash64("pid"), F.col("_chunks")))
    right = train.join(plan, "cell").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks").cast("bigint") - 1))
    )
    # a task holds several small cells, but never two large ones
    place = F.xxhash64("cell", "chunk")
    pack = F.when(F.col("_alone"), place).otherwise(F.pmod(place, F.lit(packs))).alias("pack")
    in_cell = F.concat_ws("#", F.col("chunk").cast("string"), "cell").alias("cell")
    left = left.select(pack, in_cell, "pid", "cls", "k", "floor", *columns)
    right = right.select(pack, in_cell, "train_id", *columns)
    schema = "pid bigint, cls string, sims array<double>, ids array<bigint>"
    if with_point:
        schema += ", cell string, k int" + "".join(f", {c} double" for c in columns)
    found = left.groupBy("pack").cogroup(right.groupBy("pack")).applyInArrow(_scorer(dims, with_point), schema)
    return found.withColumn("cell", F.expr("substring(cell, instr(cell, '#') + 1)")) if with_point else found


def prune_copies(serving: DataFrame, dims: int, k: int) -> DataFrame:
    """``lane, cls, cell, train_id, u0..``: at most ``k`` rows of every (lane, class, vector).

    Equal vectors tie on similarity and ties go to the smaller id, so no further copy can be chosen.
    The limit is applied before the shuffle as well as after it.
    """
    cell = F.to_json(F.struct("lane", "cls")).alias("cell")
    copies = Window.partitionBy("_at", "cell", "vec").orderBy("train_id")
    ranked = serving.select("lane", "cls", cell, "train_id", "vec").withColumn("_at", F.xxhash64("cell", "vec"))
    ranked = ranked.withColumn("_copy", F.row_number().over(copies))
    return materialize(_scalars(ranked.filter(F.col("_copy") <= k).drop("_copy", "_at"), dims))


def nearest(points: DataFrame, train: DataFrame, dims: int, k: int, cell_rows: int | None = None) -> DataFrame:
    """``pid, cls, sims, ids``: the k best training rows per point and class, exactly.

    ``points`` has ``pid, lane, cls, k, vec`` with one ``k`` per lane, at most the argument ``k``;
    ``train`` comes from :func:`prune_copies`. Order is similarity descending, then ``train_id``.
    """
    cell = F.to_json(F.struct("lane", "cls")).alias("cell")
    points = _scalars(points.select("pid", cell, "cls", "k", "vec"), dims).withColumn("floor", F.lit(-2.0))
    cut_cones = dims >= CONE_DIMS
    least = max(cell_rows or (CONE_ROWS if cut_cones else CELL_ROWS), 4 * SLICES * k)
    train, levels = (cones.split if cut_cones else _tile)(train.drop("lane", "cls"), dims, least)
    if not levels:
        return _score(points, train, dims)

    rooted = points.withColumn("root", F.col("cell"))
    home = materialize(cones.descend(rooted, levels, dims, False) if cut_cones else _descend(rooted, levels))
    # answers bring their points along, so that these need not be joined with them
    scored = materialize(_score(home.drop("root"), train, dims, True), "zstd")  # the longest table of the search
    first = scored.select("pid", "cls", "sims", "ids")
    bound = F.when(F.size("sims") >= F.col("k"), F.element_at("sims", -1)).otherwise(F.lit(-2.0))
    seeking = scored.withColumn("floor", bound).drop("sims", "ids")
    # points of cells without a training row have no answer yet
    served = materialize(train.select("cell").distinct())
    seeking = seeking.unionByName(home.drop("root").join(served, "cell", "left_anti").select(seeking.columns))
    # a cell's name is its root's, JSON, and what the cuts have added to it
    seeking = seeking.withColumnRenamed("cell", "_home").withColumn("cell", F.regexp_extract("_home", r"(?s)^(.*\})[^}]*$", 1))
    reach = F.sqrt(F.greatest(2.0 - 2.0 * F.col("floor"), F.lit(0.0)) + 1e-12)
    seeking = seeking.withColumn("_reach", reach)
    if cut_cones:
        away = cones.descend(seeking.drop("_reach"), levels, dims, True)
    else:
        away = _descend(seeking, levels, F.col("_reach")).drop("_reach")
    away = away.filter(F.col("cell") != F.col("_home")).drop("_home")
    second = _score(away, train, dims)
    # by point alone, so that the lists of its classes are gathered without another shuffle; one list is in order already
    lists = first.unionByName(second).repartition("pid").groupBy("pid", "cls").agg(F.collect_list(F.struct("sims", "ids")).alias("_l"))
    entries = F.flatten(
        F.transform("_l", lambda e: F.transform(F.arrays_zip(e["sims"].alias("s"), e["ids"].alias("i")), lambda x: F.struct((-x["s"]).alias("n"), x["i"].alias("i"))))
    )
    several = F.slice(F.sort_array(entries), 1, k)
    merged = lists.withColumn("_m", F.when(F.size("_l") > 1, several))
    one = F.get("_l", F.lit(0))
    return merged.select(
        "pid",
        "cls",
        F.when(F.col("_m").isNull(), one["sims"]).otherwise(F.transform("_m", lambda e: -e["n"])).alias("sims"),
        F.when(F.col("_m").isNull(), one["ids"]).otherwise(F.transform("_m", lambda e: e["i"])).alias("ids"),
    )


# ---------------------------------------------------------------- selection


def _entries(exclude_self: bool) -> Column:
    """All candidates of a row as ``(-similarity, id, class, rank in class)``, without the row itself."""

    def of_class(c):
        pairs = F.arrays_zip(c["sims"].alias("s"), c["ids"].alias("i"))
        if exclude_self:
            pairs = F.filter(pairs, lambda e: e["i"] != F.col("query_id"))
        return F.transform(
            pairs, lambda e, r: F.struct((-e["s"]).alias("n"), e["i"].alias("id"), c["cls"].alias("cls"), (r + 1).alias("r"))
        )

    return F.flatten(F.transform("_found", of_class))


def _first(entries: Column, count: Column) -> Column:
    return F.slice(F.sort_array(entries), F.lit(1), F.greatest(count, F.lit(0)))


def _supply(serving: DataFrame, n: int, k: int, balance: str) -> DataFrame:
    """``lane, _c, k``: the classes of every lane and how many candidates each must deliver.

    When every class can fill its quota plus one remainder row, nothing is backfilled from other
    classes and so much per class is enough; otherwise a class may have to deliver all n.
    """
    sizes = serving.groupBy("lane", "cls").agg(F.count(F.lit(1)).alias("_rows"))
    lanes = sizes.groupBy("lane").agg(F.collect_set("cls").alias("_c"), F.min("_rows").alias("_least"))
    spare = k - n
    if balance == BINARY:
        quota = F.lit(n - n // 2 + spare)
    else:
        quota = F.floor(F.lit(n) / F.size("_c")).cast("int") + 1 + spare
    enough = (F.col("_least") >= quota) & (F.size("_c") > 1)
    return lanes.select("lane", "_c", F.when(enough, F.least(quota, F.lit(k))).otherwise(F.lit(k)).alias("k"))


def _pick(n: int, balance: str | None) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last one, ``_chosen``, holds the selected entries."""
    everything = F.col("_all")
    if balance is None:
        return [("_chosen", _first(everything, F.lit(n)))]
    if balance == BINARY:
        quota = F.lit(n // 2 + n % 2)
        inside = lambda e: e["r"] <= F.when(e["cls"] == "1", F.lit(n // 2)).otherwise(quota)
        return [
            ("_picked", F.filter(everything, inside)),
            ("_spare", F.filter(everything, lambda e: ~inside(e))),
            ("_chosen", F.sort_array(F.concat("_picked", _first(F.col("_spare"), F.lit(n) - F.size("_picked"))))),
        ]
    each = F.floor(F.lit(n) / F.greatest(F.col("_classes"), F.lit(1))).cast("int")
    several = F.sort_array(
        F.concat("_picked", "_next", _first(F.array_except("_spare", "_next"), F.lit(n) - F.size("_picked") - F.size("_next")))
    )
    return [
        ("_classes", F.size(F.array_distinct(F.transform(everything, lambda e: e["cls"])))),
        ("_each", each),
        ("_picked", F.filter(everything, lambda e: e["r"] <= F.col("_each"))),
        ("_spare", F.filter(everything, lambda e: e["r"] > F.col("_each"))),
        (
            "_next",
            _first(
                F.filter("_spare", lambda e: e["r"] == F.col("_each") + 1),
                F.lit(n) - F.col("_each") * F.greatest(F.col("_classes"), F.lit(1)),
            ),
        ),
        ("_chosen", F.when(F.col("_classes") <= 1, _first(everything, F.lit(n))).otherwise(several)),
    ]


def similar_rows(
    query: DataFrame,
    train: DataFrame,
    spec: TableSpec,
    n: int,
    balanced: bool = False,
    exclude_self: bool = False,
    binarize=None,
    cell_rows: int | None = None,
) -> DataFrame:
    """``query_id, depth, cases``: per query row its selected training rows, best first.

    Both tables carry ``_row_id``, the features and the target; statistics and candidates come from
    ``train`` only. ``exclude_self`` leaves out the training row with the query's own id.
    ``cases`` is an array of ``(train_id, similarity)``; rows without candidates have an empty one.
    """
    spec = spec.resolve(train)
    vectors = list(spec.vector_cols)
    dims = len(vectors)
    params = scale_params(train, vectors).first().asDict() if vectors else {}
    needed = ["_row_id", *spec.match_cols]
    numeric = dict(train.dtypes)[spec.target] not in ("string", "boolean")

    def prepared(df):
        target = F.col(spec.target) if spec.target in df.columns else F.lit(None)
        return unit_vectors(df, params, vectors).select(*needed, target.alias("_target"), "vec")

    train_rows = materialize(prepared(train))
    query_rows = train_rows if query is train else materialize(prepared(query))
    queries, serving = match_groups(query_rows, train_rows, spec, n)
    if balanced:
        queries, serving = _with_classes(queries, serving, spec, "_target", numeric, exclude_self, binarize)
        balance = MULTICLASS if spec.task == MULTICLASS else BINARY
    else:
        queries, serving = queries.withColumn("lane", F.col("group")), serving.withColumn("lane", F.col("group"))
        serving = serving.withColumn("cls", F.lit(""))
        balance = None
    k = n + 1 if exclude_self else n
    # a number before text and vector: sorts compare it first
    queries = queries.select(F.col("_row_id").alias("query_id"), F.xxhash64("lane", "vec").alias("_at"), "lane", "depth", "vec")
    queries = materialize(queries)
    points = queries.groupBy("_at", "lane", "vec").agg(F.min("query_id").alias("pid"), F.count(F.lit(1)).alias("_queries"))
    points = materialize(points)
    crowded = not points.filter(F.col("_queries") > MANY_COPIES).isEmpty()
    points = points.drop("_queries")
    serving = prune_copies(serving.withColumnRenamed("_row_id", "train_id"), dims, k)
    if balance is None:
        classed = points.withColumn("cls", F.lit("")).withColumn("k", F.lit(k))
    else:
        classed = lookup_join(points, _supply(serving, n, k, balance), ["lane"], "inner")
        classed = classed.withColumn("cls", F.explode("_c")).drop("_c")
    found = nearest(classed, serving, dims, k, cell_rows)
    per_point = found.groupBy("pid").agg(F.collect_list(F.struct("cls", "sims", "ids")).alias("_found"))
    if crowded:
        # the rows of a crowded point are split among tasks, for which its answer travels
        answers = points.join(per_point, "pid", "left").select("_at", "lane", "vec", "_found")
        out = lookup_join(queries, answers, ["_at", "lane", "vec"])
    else:
        # answers are long and lie by point: rows, which are short, go there
        asked = lookup_join(queries, points, ["_at", "lane", "vec"]).select("query_id", "depth", "pid")
        out = asked.join(per_point.hint("merge"), "pid", "left")
    empty = F.array().cast("array<struct<cls:string,sims:array<double>,ids:array<bigint>>>")
    out = out.withColumn("_found", F.coalesce("_found", empty)).withColumn("_all", _entries(exclude_self))
    for name, column in _pick(n, balance):
        out = out.withColumn(name, column)
    cases = F.transform("_chosen", lambda e: F.struct(e["id"].alias("train_id"), (-e["n"]).alias("similarity")))
    return out.select("query_id", "depth", cases.alias("cases"))


def neighbors(*args, **kwargs) -> DataFrame:
    """:func:`similar_rows` in long form: ``query_id, train_id, similarity, rank``."""
    found = similar_rows(*args, **kwargs)
    # the outer form keeps the optimizer from repeating the whole selection in a size filter
    listed = found.select("query_id", F.posexplode_outer("cases").alias("_p", "_c")).filter("_p is not null")
    return listed.select(
        "query_id", "_c.train_id", "_c.similarity", (F.col("_p") + 1).cast("bigint").alias("rank")
    )


def random_neighbors(query: DataFrame, train: DataFrame, n: int, seed: int = 42, exclude_self: bool = False) -> DataFrame:
    """n seeded picks per query, similarity 1.0: an equi-join on a position in hash order.

    A query starts at a hashed position and walks with a step coprime to the table size, so picks are
    distinct and every training row is hit about equally often.
    """
    ranked = hash_ranked(train.select(F.col("_row_id").alias("train_id")), [], seed, "random", "train_id", "_pos")
    ranked = ranked.select("train_id", (F.col("_pos") - 1).alias("_pos"))
    size = train.count()
    if size == 0:
        return ranked.select(F.col("train_id").alias("query_id"), "train_id", F.lit(1.0).alias("similarity"), F.col("_pos").alias("rank"))
    step = next(s for s in range(max(1, int(size * 0.618)), 2 * size + 2) if math.gcd(s, size) == 1)
    tries = min(size, n + 1 if exclude_self else n)
    start = F.pmod(F.conv(F.substring(seeded_hash(seed, "start", "_row_id"), 1, 12), 16, 10).cast("bigint"), F.lit(size))
    walks = query.select(F.col("_row_id").alias("query_id"), start.alias("_start")).select(
        "query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.pmod(
            F.col("_start") + i.cast("bigint") * F.lit(step), F.lit(size)))).alias("_try", "_pos")
    )
    # a merge join at every size: Spark takes the walks, n rows per query, for as small as the queries and would broadcast them
    picked = walks.join(ranked.hint("merge"), "_pos")
    if exclude_self:
        picked = picked.filter(F.col("train_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("_try")
    return (
        picked.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= n)
        .select("query_id", "train_id", F.lit(1.0).alias("similarity"), "rank")
    )
