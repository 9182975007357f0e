"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents with equal shingle sets are one text.  Each trie of the forest orders
texts by its own run of MinHash values; texts that share a prefix are
candidates.  A prefix starts at full depth and is shortened until the recall
target is met at the threshold similarity; where a short prefix is shared by
too many texts, deeper prefixes and the leaders of the deeper buckets are
matched first, and then all pairs of the short one that these left in different
groups, block by block.  Candidates by signature are
joined to groups, and all pairs within a group are verified on the whole
shingle sets, block by block, inside the tasks: only counts and spanning edges
leave a task, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.components import components
from seasoncast.llm.textvec import mix, pieces, rolling
from seasoncast.session import materialise


@dataclass(frozen=True)
class ForestRules:
    """Production settings: five-word shingles, Jaccard similarity of 0.8 or more."""

    width: int = 5
    ninths: int = 4           # J >= 0.8 is 9 * common >= 4 * (size of a + size of b)
    threshold: float = 0.8
    recall: float = 0.9999
    tries: int = 25
    values: int = 125
    deepest: int = 16
    floor: float = 0.62       # signature similarity of candidates: five standard errors below the threshold
    bucket: int = 1500        # texts of a bucket that one task compares with one another
    block: int = 1500         # texts of a group that one task compares with another such block
    seed: int = 2


def shortest_prefix(rules: ForestRules) -> int:
    """Shorten from the deepest prefix until one of the tries matches at the target recall."""
    for depth in range(rules.deepest, 0, -1):
        if 1 - (1 - rules.threshold ** depth) ** rules.tries >= rules.recall:
            return depth
    return 1


def shingles(piece, width: int):
    """Distinct shingle hashes of each text: ``(document, hash)`` sorted; under ``width`` words, all words are one shingle."""
    start, end, doc = piece.words()
    word = piece.hasher(start, end)
    at, run = rolling(word, doc, width)
    count = np.bincount(doc, minlength=piece.n)
    short = np.flatnonzero((count > 0) & (count < width))
    first = np.searchsorted(doc, short)
    alone = []
    for k, d in zip(first, short):
        value = np.zeros(1, np.uint64)
        for w in word[k:k + count[d]]:
            value = mix(value * np.uint64(31) + w)
        alone.append(value[0])
    doc, run = np.concatenate([doc[at], short]), np.concatenate([run, np.array(alone, np.uint64)])
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
    return doc[new], run[new]


def _set_ids(doc: np.ndarray, run: np.ndarray, n: int):
    """A 64-bit digest of each text's shingle set, and where the set starts."""
    starts = np.searchsorted(doc, np.arange(n + 1))
    sums = np.zeros(len(run) + 1, np.uint64)
    np.cumsum(mix(run), out=sums[1:])
    size = np.diff(starts)
    return mix((sums[starts[1:]] - sums[starts[:-1]]) ^ mix(size.astype(np.uint64))).view(np.int64), starts


def signatures(docs: DataFrame, rules: ForestRules) -> DataFrame:
    """``(doc_id, row, id, size, sig)``: digest of each row's text; digest, size and MinHash values of its shingle set; no shingle: null id."""
    rng = np.random.default_rng(rules.seed)
    times, plus = rng.integers(0, 1 << 32, (2, rules.values), dtype=np.uint32)
    times |= np.uint32(1)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                doc, hashes = shingles(piece, rules.width)
                ids, starts = _set_ids(doc, hashes, piece.n)
                full = np.flatnonzero(np.diff(starts))
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                sig = np.empty((len(full), rules.values), np.uint32)
                for v in range(rules.values):
                    if len(full):
                        sig[:, v] = np.minimum.reduceat((short ^ plus[v]) * times[v], starts[full])
                place = np.full(piece.n, -1)
                place[full] = np.arange(len(full))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.n), batch.column(2).slice(piece.first, piece.n), pa.array(ids, mask=place < 0), pa.array(np.diff(starts)),
                     pa.array([sig[k].tobytes() if k >= 0 else None for k in place], pa.binary())], ["doc_id", "row", "id", "size", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, row long, id long, size long, sig binary")


def prefix_keys(texts: DataFrame, rules: ForestRules, depths: tuple) -> DataFrame:
    """``(id, trie, short, deep)``: for every trie the hashes of the prefixes of both depths."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, rules.values).astype(np.uint64)
            for t in range(rules.tries):
                key, out = np.full(len(sig), mix(np.array([t + 1], np.uint64))[0], np.uint64), []
                for d in range(max(depths)):
                    key = mix(key ^ (sig[:, (t * depths[0] + d * (1 + t * (d >= depths[0]))) % rules.values] + np.uint64(d << 33)))
                    if d + 1 in depths:
                        out.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["id", "short", "deep"])

    return texts.select("id", "sig").mapInArrow(run, "id long, short long, deep long")


def shared_prefixes(texts: DataFrame, rules: ForestRules) -> DataFrame:
    """``(short, id, deep, n)`` of the short prefixes that ``n`` texts share, two or more."""
    depth = shortest_prefix(rules)
    keys = materialise(prefix_keys(texts, rules, (depth, max(depth + 1, rules.deepest))), "prefixes")
    many = keys.groupBy("short").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(keys.join(many, "short"), "shared")


def buckets(shared: DataFrame, rules: ForestRules) -> DataFrame:
    """``(bucket, id)`` of all prefixes that texts share, no bucket over about ``rules.bucket``.

    A short prefix shared by more is replaced by its deep ones (salted where
    even those are too many) and by buckets of the leaders of these; the pairs
    that this leaves out are those of :func:`remaining_edges`.
    """
    small = shared.where(F.col("n") <= rules.bucket).select(F.col("short").alias("bucket"), "id")
    parts = lambda n: F.ceil(F.col(n) / F.lit(rules.bucket * 2 // 3))
    hot = shared.where(F.col("n") > rules.bucket)
    deep = (hot.join(hot.groupBy("short", "deep").agg(F.count("*").alias("m")), ["short", "deep"])
            .select("short", "id", F.xxhash64("short", "deep", F.pmod(F.xxhash64("id"), F.when(F.col("m") > rules.bucket, parts("m")).otherwise(1))).alias("bucket")))
    deep = materialise(deep, "deep")
    leaders = deep.groupBy("short", "bucket").agg(F.min("id").alias("id"))
    # leaders of one short prefix, in overlapping slices if they are too many: each has the least leader in it
    counted = leaders.groupBy("short").agg(F.count("*").alias("k"), F.min("id").alias("least"))
    sliced = leaders.join(counted, "short").withColumn("slices", parts("k")).withColumn("bucket", F.xxhash64("short", F.lit("leaders"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices"))))
    hubs = sliced.groupBy("bucket").agg(F.min("least").alias("id"))
    return small.union(deep.select("bucket", "id")).union(sliced.select("bucket", "id")).union(hubs.select("bucket", "id")).distinct()


def _forest(links: np.ndarray) -> np.ndarray:
    """Least member of each node's component, from a boolean adjacency matrix."""
    label = np.arange(len(links), dtype=np.int32)
    while True:
        near = np.concatenate([np.where(links[a:a + 256], label[None, :], np.int32(len(links))).min(axis=1) for a in range(0, len(links), 256)])
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches, n_keys: int):
    """Rows of one key, whole, from batches that are sorted by their first ``n_keys`` columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[a].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _low(rules: ForestRules):
    """Signatures, the last column, cut to a byte a value."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint32).reshape(batch.num_rows, rules.values)
                low = np.ascontiguousarray((sig >> np.uint32(7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in low], pa.binary())], batch.schema.names)
    return run


def candidate_edges(texts: DataFrame, rules: ForestRules) -> DataFrame:
    """Edges ``(a, b)`` that span the signature-similar texts of every short prefix."""
    shared = shared_prefixes(texts, rules)
    placed = buckets(shared, rules).groupBy("id").agg(F.collect_list("bucket").alias("places"))  # a few a trie at most
    rows = (placed.join(texts.select("id", "sig"), "id").select(F.explode("places").alias("bucket"), "id", "sig"))

    def match(batches):
        for _, rows in _groups(batches, 1):
            ids = rows.column(1).to_numpy()
            if len(ids) < 2:
                continue
            sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(len(ids), rules.values)
            order = np.argsort(ids, kind="stable")
            ids, sig = ids[order], sig[order]
            links = np.zeros((len(ids), len(ids)), bool)
            for i in range(len(ids)):
                links[i] = (sig == sig[i]).sum(axis=1) >= rules.floor * rules.values
            root = _forest(links)
            own = np.flatnonzero(root != np.arange(len(ids)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    edges = (rows.mapInArrow(_low(rules), "bucket long, id long, sig binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
             .mapInArrow(match, "a long, b long").distinct())
    hot = shared.where(F.col("n") > rules.bucket).select("short", "id")
    if hot.isEmpty():
        return edges
    edges = materialise(edges, "edges")
    return edges.union(remaining_edges(texts, hot, edges, rules)).distinct()


def remaining_edges(texts: DataFrame, hot: DataFrame, edges: DataFrame, rules: ForestRules) -> DataFrame:
    """``(a, b)`` edges that the texts of the ``hot`` prefixes lack: all pairs of one prefix in different groups of ``edges`` are compared.

    A prefix whose texts are one group has none.  The others are cut into blocks
    by a hash of the id, and each block meets each other in a task of its own.
    """
    placed = hot.join(components(edges), "id", "left").select("short", "id", F.coalesce("component", "id").alias("component"))
    placed = materialise(placed, "hot")
    parted = (placed.groupBy("short").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
              .where("low < high").select("short", F.ceil(F.col("n") / rules.block).alias("blocks")))
    cut = (placed.join(parted, "short").join(texts.select("id", "sig"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
           .select("short", "id", "component", "own", "blocks", "sig")
           .mapInArrow(_low(rules), "short long, id long, component long, own long, blocks long, sig binary"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = met.select("short", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                      "id", "component", (F.col("own") > F.col("other")).cast("int").alias("side"), "sig")
    values, least = rules.values, rules.floor * rules.values

    def match(batches):
        for (_, left, right), rows in _groups(batches, 3):
            ids, component, side = (rows.column(c).to_numpy() for c in ("id", "component", "side"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), values)
            links = component[:, None] == component
            if links.all():
                continue
            first = np.flatnonzero(side == 0)
            second = first if left == right else np.flatnonzero(side == 1)
            other = sig[second]
            for i in first:
                near = second[(other == sig[i]).sum(axis=1) >= least]
                links[i, near] = links[near, i] = True
            root = _forest(links)
            own = np.flatnonzero(component[root] != component)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    keys = ["short", "left", "right"]
    return (rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(match, "a long, b long").distinct())


def shingle_sets(docs: DataFrame, wanted: DataFrame, rules: ForestRules, bitmap: int = 1 << 20) -> DataFrame:
    """``(id, hashes)`` for the ids of ``wanted``, once each.

    The documents are read again; a bitmap of fixed size spares most of the
    others, the rest go in the join.
    """
    marks = np.zeros(bitmap, bool)
    marks[[r[0] for r in wanted.select(F.col("id").bitwiseAND(F.lit(bitmap - 1))).distinct().collect()]] = True
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        seen = set()
        for batch in batches:
            for piece in pieces(batch.column(0)):
                doc, hashes = shingles(piece, rules.width)
                ids, starts = _set_ids(doc, hashes, piece.n)
                pick = [k for k in np.flatnonzero(np.diff(starts)) if held.value[ids[k] & (bitmap - 1)] and not (ids[k] in seen or seen.add(ids[k]))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array([hashes[starts[k]:starts[k + 1]].tobytes() for k in pick], pa.binary())], ["id", "hashes"])

    return (docs.select("text").mapInArrow(run, "id long, hashes binary").join(wanted, "id")
            .groupBy(*wanted.columns).agg(F.first("hashes").alias("hashes")))


def _incidence(cells, rows, n_rows, width):
    out = np.zeros((n_rows, width), np.float32)
    out[rows, cells] = 1
    return out


def _verify(ids, weight, raw, side, rules):
    """Exact links of one block (``side`` all 0) or between two: per text the weight and number of links, and its root."""
    sets = [np.frombuffer(r, np.uint64) for r in raw]
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, cell, held = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size)
    common = held[cell] > 1  # a shingle of one text only is common to none
    number = np.cumsum(held > 1) - 1
    row, cell = row[common], number[cell[common]]
    width = int((held > 1).sum())
    links = np.zeros((len(ids), len(ids)), bool)
    step = int(np.clip(6_000_000 // max(width, 1), 8, 512))
    cuts = np.searchsorted(row, np.arange(len(ids) + 1))

    def part(a):
        b = min(a + step, len(ids))
        s = slice(cuts[a], cuts[b])
        return _incidence(cell[s], row[s] - a, b - a, width)

    for a in range(0, len(ids), step):
        left = part(a)
        for b in range(a, len(ids), step):
            both = left @ (left if a == b else part(b)).T
            near = 9 * both >= rules.ninths * (size[a:a + step, None] + size[None, b:b + step])
            links[a:a + step, b:b + step] = near
            links[b:b + step, a:a + step] = near.T
    np.fill_diagonal(links, False)
    if side.any():
        links &= side[:, None] != side[None, :]
    return links @ weight, links.sum(axis=1), _forest(links)


def verified(sets: DataFrame, rules: ForestRules) -> DataFrame:
    """``(id, links, texts, root)``: a row for each text and block pair in which it has links.

    ``sets`` has ``id, copies, component, members, hashes``.  A group of more
    than ``rules.block`` texts is cut into blocks by a hash of the id, and each
    block meets each other in a task of its own.
    """
    n = F.ceil(F.col("members") / rules.block)
    cut = sets.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pair = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    rows = met.select(pair.alias("pair"), "id", "copies", (F.col("own") > F.col("other")).cast("int").alias("side"),
                      (F.col("own") == F.col("other")).alias("same"), "hashes")

    def run(batches):
        for _, rows in _groups(batches, 1):
            rows = rows.combine_chunks().sort_by("id")
            if rows.num_rows > 1:
                ids, weight = rows["id"].to_numpy(), rows["copies"].to_numpy()
                got, texts, root = _verify(ids, weight, rows["hashes"].to_pylist(), np.zeros(len(ids), int) if rows["same"][0].as_py() else rows["side"].to_numpy(), rules)
                own = np.flatnonzero(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(got[own]), pa.array(texts[own]), pa.array(ids[root[own]])], ["id", "links", "texts", "root"])

    return (rows.repartition(F.col("pair")).sortWithinPartitions("pair").mapInArrow(run, "id long, links long, texts long, root long"))


def jaccard_classes(docs: DataFrame, rules: ForestRules = ForestRules()) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, n_text_links, n_copies``.

    ``class_id`` is the least doc_id of the row's class (texts joined by links),
    ``n_links`` the number of other rows that are linked to this one, copies
    included; ``n_text_links`` counts linked texts with another shingle set and
    ``n_copies`` the rows with the same one.  A null, empty or blank text has no
    shingle, no link, and its own doc_id as class.  Repeated rows are copies of
    each other; extra columns are ignored; an empty table gives no rows.
    """
    return _classes(docs, rules).drop("row", "class_row")


def _classes(docs: DataFrame, rules: ForestRules) -> DataFrame:
    """:func:`jaccard_classes` with ``row``, the digest of the row's text, and ``class_row``: of the class's row with the least (doc_id, row)."""
    rows = materialise(signatures(docs, rules), "signatures")
    texts = materialise(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("copies"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("least"), F.first("sig").alias("sig")), "texts")
    groups = components(candidate_edges(texts, rules))
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    wanted = materialise(groups.join(sizes, "component").join(texts.select("id", "copies"), "id").select("id", "copies", "component", "members"), "wanted")
    checked = materialise(verified(shingle_sets(docs, wanted, rules), rules), "checked")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (texts.select("id", "copies", "least").join(classes, "id", "left").join(links, "id", "left")
             .withColumn("component", F.coalesce("component", "id")))
    least = known.groupBy("component").agg(F.min("least").alias("kept"))
    known = materialise(known.join(least, "component").select("id", F.col("kept.doc_id").alias("class_id"), F.col("kept.row").alias("class_row"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")), "known")
    return (rows.select("doc_id", "row", "id").join(known, "id", "left")
            .select("doc_id", "row", "class_row", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"),
                    F.coalesce("copies", F.lit(1)).alias("n_copies")))


def one_of_each(docs: DataFrame, rules: ForestRules = ForestRules()) -> DataFrame:
    """The documents, all columns, one of each class: the row with the least doc_id, then the least digest of its text.

    Rows, not ids, go: different texts under one doc_id stay unless they are
    linked.  Of rows with equal doc_id and text one stays; rows without doc_id
    and texts without words all do.
    """
    named = materialise(_classes(docs, rules), "classes").where("doc_id is not null")
    fates = named.groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).agg(
        F.bool_or(F.expr("class_row is not null and (doc_id <> class_id or row <> class_row)")).alias("__gone"), F.count("*").alias("n"))
    fates = materialise(fates.where("__gone or n > 1").select("__doc", "__row", F.coalesce("__gone", F.lit(False)).alias("__gone")), "fates")
    whole = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_r"), F.struct("*").alias("whole"))  # keeps columns of any name apart
    # The list grows with the documents: one merge join at any size, whose order also serves the count of equal rows.
    met = whole.join(fates.hint("merge"), (F.col("_d") == F.col("__doc")) & (F.col("_r") == F.col("__row")), "left").where("__gone is null or not __gone")
    equal = Window.partitionBy("_d", "_r").orderBy(F.lit(0))
    return met.withColumn("nth", F.row_number().over(equal)).where("__gone is null or nth = 1").select("whole.*")
