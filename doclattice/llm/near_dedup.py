"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document's set holds its distinct 5-word shingles. Equal sets are one class from the start. The
``COORDINATES`` first minima of a class's set are its signature; every (coordinate, value) is a token
with a list of the classes that have it. Sets with a Jaccard similarity of 0.75 agree in 96 of 128
coordinates on average, in fewer than ``MATCHES`` with a probability of about 1e-9. Pairs with
``MATCHES`` equal coordinates share one of the first ``COORDINATES - MATCHES + 1`` tokens of either
(prefix merging), tokens ordered by how common they are: the commonest tokens of a document are
skipped, so lines and passages that are everywhere post next to nothing. Collisions of a candidate
pair are counted over all coordinates, and it is retained from ``MATCHES`` on; what remains is
confirmed on full sets.

Lists do not become pairs. Every list has a leader, the member that is in the longest lists, and every
class is compared with one: the leader it shares most lists with. Classes that match the same leader
are a star; where links leave a star in several components, its members are compared on full sets in
blocks of bounded size, which give links only. At last, members outside the main component of a list
are compared with the members of its other components. Sketches, one bit of each of ``BITS`` minima,
keep that join small: pairs further apart than ``MOST_APART`` bits (a similarity of 0.75 exceeds that
with a probability of about 1e-10) never become rows, and a pair that meets in several lists is skipped
in all but one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.graph import components
from doclattice.llm.hashing import Block, blocks, encoded, mix, range_sums, window_hashes
from doclattice.llm.tables import text_or_empty, written

_U = np.uint64
SHINGLE = 5
COORDINATES, MATCHES = 128, 66
BITS, MOST_APART = 1024, 200
PREFIX = COORDINATES - MATCHES + 1
#: Counters for how common a token is: a fixed number, so they can travel to every task. Any table
#: gives a right order of tokens; a fuller one only orders rare tokens less well.
COUNTERS = 1 << 18
_RUN = 4096  # counters to a row
#: Bits for each document whose set is wanted, and the most that travel to every task (32 MB), so that no
#: text is shuffled. Where they are too few, more sets are made than needed, which later joins drop.
ID_BITS_EACH, MOST_ID_BITS = 16, 1 << 28
#: Classes and bytes of their sets in a block of a star.
STAR_ROWS, STAR_BYTES = 256, 4 << 20
#: Bytes of text worked on at once: their shingles stay in the processor's cache.
CACHED = 1 << 19
#: Linked from 100 * intersection >= SIMILARITY * union on.
SIMILARITY = 75
_FACTORS = (mix(np.arange(1, BITS + 1, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words between ASCII blanks, A-Z lower-cased; a
    text of fewer words is one shingle, one without words has none."""
    block = Block(texts)
    block.split_words()
    words = block.word_hashes(lower=True)
    at = block.windows(SHINGLE)
    hashes = window_hashes(words, at, SHINGLE)
    cut = np.searchsorted(block.word_text[at], np.arange(block.n + 1)) if len(at) else np.zeros(block.n + 1, int)
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < SHINGLE))
    begin = block.first[:-1][short]
    whole = mix(range_sums(words, begin, begin + block.n_words[short], 0) + block.n_words[short].astype(_U))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = np.sort(hashes[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if b > a else own)
    for i, h in zip(short.tolist(), whole):
        out[i] = np.array([h], _U)
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BITS minima per set; sets must not be empty."""
    joined = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    start = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(joined * f, start) for f in _FACTORS], axis=1)


def sketches(least: np.ndarray) -> np.ndarray:
    """One bit of every minimum, in rows of BITS / 64 longs."""
    bit = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bit.astype(bool), axis=1).view("<i8")


def _blocks_of(batches):
    for batch in batches:
        texts = encoded(batch.column(1).to_pylist())
        for a, b in blocks(texts, CACHED):
            yield batch.column(0).slice(a, b - a), texts[a:b]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, sketch); empty sets have none of the last three."""

    def run(batches):
        for ids, texts in _blocks_of(batches):
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature, sketch, digest = ([None] * len(sets) for _ in range(3))
            if full:
                least = minima([sets[i] for i in full])
                for i, row, bits in zip(full, least[:, :COORDINATES].view("<i4"), sketches(least)):
                    signature[i], sketch[i] = row, bits
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(signature, pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "signature", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, signature array<int>, sketch array<long>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).view("<u4").reshape(-1, COORDINATES)


def _tokens(signature: np.ndarray) -> np.ndarray:
    return mix((np.arange(COORDINATES, dtype=_U) << _U(32)) + signature.astype(_U))


def token_counts(classes: DataFrame) -> np.ndarray:
    """How many classes have a token that falls on each of COUNTERS counters, over all classes."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount((_tokens(_matrix(batch.column(0))) % _U(COUNTERS)).astype(np.int64).ravel(), minlength=COUNTERS)
        rows = total.reshape(-1, _RUN)
        full = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([rows[i].tobytes() for i in full], pa.binary())], ["at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("n").to_pylist())
        small = np.minimum(total, 2**31 - 1).astype("<i4")
        return pa.table({"at": table.column("at").slice(0, 1), "n": pa.array([small.tobytes()], pa.binary())})

    rows = classes.select("signature").mapInArrow(run, "at long, n binary").groupBy("at").applyInArrow(add, "at long, n binary")
    out = np.zeros((COUNTERS // _RUN, _RUN), np.int32)
    for row in rows.collect():  # COUNTERS / _RUN rows
        out[row["at"]] = np.frombuffer(row["n"], "<i4")
    return out.ravel()


def posted(classes: DataFrame) -> DataFrame:
    """(token, node): the prefix tokens of every class that another class has too."""
    common = classes.sparkSession.sparkContext.broadcast(token_counts(classes))

    def run(batches):
        count = common.value
        for batch in batches:
            tokens = _tokens(_matrix(batch.column(1)))
            # Common tokens last; equal counts by the token itself, so the order is the same everywhere.
            rank = (count[(tokens % _U(COUNTERS)).astype(np.int64)].astype(_U) << _U(32)) | (tokens >> _U(32))
            pick = np.argsort(rank, axis=1, kind="stable")[:, :PREFIX]
            node = np.repeat(batch.column(0).to_numpy(), PREFIX)
            token = np.take_along_axis(tokens, pick, axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node)], ["token", "node"])

    rows = classes.select("node", "signature").mapInArrow(run, "token long, node long")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    return rows.join(shared, "token")


def _with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds n_a, s_a, n_b, s_b: set sizes and signatures of both."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that collide in at least MATCHES coordinates."""
    both = _with_classes(pairs.select("a", "b"), classes).filter(_sizes_fit("n_a", "n_b"))
    equal = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.filter(equal >= MATCHES).select("a", "b")


def _apart_bits(a: str, b: str):
    """Number of bits in which two sketches differ."""
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64))


def _sizes_fit(a: str, b: str):
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _id_bit(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.view(_U)) % _U(size)).astype(np.int64)


def wanted_bits(nodes: DataFrame) -> np.ndarray:
    """One bit for every node's id, packed: partial bitmaps of the tasks, united by pieces. The number
    of bits follows from the number of nodes, up to MOST_ID_BITS."""
    size = 8 * _RUN
    while size < min(ID_BITS_EACH * nodes.count(), MOST_ID_BITS):
        size *= 2

    def run(batches):
        marks = np.zeros(size, bool)
        for batch in batches:
            marks[_id_bit(batch.column(0).to_numpy(), size)] = True
        pieces = np.packbits(marks).reshape(-1, _RUN)
        full = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([pieces[i].tobytes() for i in full], pa.binary())], ["at", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    rows = nodes.select("node").mapInArrow(run, "at long, bits binary").groupBy("at").applyInArrow(unite, "at long, bits binary")
    out = np.zeros((size // 8 // _RUN, _RUN), np.uint8)
    for row in rows.collect():  # size / 8 bytes in all
        out[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes): the whole sets of the documents that stand for the given classes, and of the
    few others whose ids fall on the same bits."""
    marks = docs.sparkSession.sparkContext.broadcast(wanted_bits(nodes))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = _id_bit(ids, 8 * len(marks.value))
            mine = (marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            for own, texts in _blocks_of([batch.filter(pa.array(mine))]):
                yield pa.RecordBatch.from_arrays([own, pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["node", "hashes"])

    known = docs.filter(F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
                joined = np.sort(np.concatenate([a, b]))
                both = int((joined[1:] == joined[:-1]).sum())
                keep.append(100 * both >= SIMILARITY * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")
    return both.mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """The component of each node in ``column``: itself if no link reaches it."""
    known = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


class _Links:
    """Confirmed links, the sets they were confirmed on, and the components they make."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes, self.sets, self.found, self.labels = docs, classes, None, None, None

    def add(self, links: DataFrame) -> None:
        links = written(links.select("a", "b").distinct(), "found-links")
        if not links.isEmpty():
            self.found = links if self.found is None else self.found.unionByName(links)
            self.labels = components(self.found)

    def test(self, pairs: DataFrame) -> None:
        """Confirm written pairs on their full sets and take in the links."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            ends = ends.join(self.sets.select("node"), "node", "left_anti")
        ends = written(ends, "wanted-sets")
        if self.sets is None or not ends.isEmpty():
            new = written(full_sets(self.docs, ends), "shingle-sets")
            self.sets = new if self.sets is None else self.sets.unionByName(new)
        self.add(confirmed(pairs, self.sets))

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("component", F.col("node"))
        return _labelled(rows, self.labels, "node", "component")

    def mixed(self, lists: DataFrame) -> DataFrame:
        """(token, node, component, main): lists whose members are in several components, and the
        component that most of them are in."""
        lists = self.labelled(lists.select("token", "node"))
        weight = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
        main = weight.groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
        return written(lists.join(main.filter("parts > 1").select("token", F.col("m.component").alias("main")), "token"), "mixed-lists")


def _leaders(lists: DataFrame) -> DataFrame:
    """(node, leader): every class and, of the leaders of its lists, the one it shares most of them
    with. The leader of a list is the member whose lists are longest in all: among near copies that is
    the one with the fewest changes, which most others are similar to."""
    longest = lists.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    weight = lists.join(longest, "token").groupBy("node").agg(F.sum("n").alias("weight"))
    first = F.max(F.struct("weight", F.xxhash64("node"), "node"))["node"].alias("leader")
    leader = lists.join(weight, "node").groupBy("token").agg(first)
    shared = lists.join(leader, "token").filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("node").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star_links(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among classes that match one leader, ``stars(pivot, node, component, n_shingles)``.

    Members outside the main component of a star are compared with its members of other components on
    full sets, in blocks of bounded size: pairs never become rows, and a member gives at most one link
    to each component in a block.
    """
    part = stars.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    main = part.groupBy("pivot").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("n"), F.sum("size").alias("size")).filter("parts > 1")
    cut = F.greatest(F.ceil(F.col("n") / STAR_ROWS), F.ceil(8 * F.col("size") / STAR_BYTES)).cast("int")
    member = stars.join(main.select("pivot", "main", cut.alias("cut")), "pivot")
    member = member.join(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    member = written(member, "star-members")
    every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    x = member.filter("component <> main").select("pivot", F.col("own").alias("x"), every.alias("y"), "node", "component", "hashes")
    y = member.select("pivot", every.alias("x"), F.col("own").alias("y"), "node", "component", "hashes")

    def side(table: pa.Table):
        return table.column("node").to_numpy(), table.column("component").to_numpy(), [np.frombuffer(h, _U) for h in table.column("hashes").to_pylist()]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        (na, ca, sa), (nb, cb, sb) = side(left), side(right)
        if not len(na) or not len(nb):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size_a, size_b = (np.array([len(v) for v in s]) for s in (sa, sb))
        kinds, which = np.unique(np.concatenate([*sa, *sb]), return_inverse=True)
        in_a, in_b = which[:size_a.sum()], which[size_a.sum():]
        shared = np.zeros(len(kinds), bool)
        shared[in_b] = True
        shared &= np.bincount(in_a, minlength=len(kinds)) > 0
        column = np.cumsum(shared) - 1
        both = np.zeros((len(na), len(nb)), np.float32)
        row_a, row_b = np.repeat(np.arange(len(na)), size_a), np.repeat(np.arange(len(nb)), size_b)
        (row_a, in_a), (row_b, in_b) = ((r[shared[k]], column[k[shared[k]]]) for r, k in ((row_a, in_a), (row_b, in_b)))
        for at in range(0, int(shared.sum()), 2048):  # columns of a 0/1 matrix, some at a time
            mark = []
            for n, r, k in ((len(na), row_a, in_a), (len(nb), row_b, in_b)):
                here = (k >= at) & (k < at + 2048)
                dense = np.zeros((n, 2048), np.float32)
                dense[r[here], k[here] - at] = 1
                mark.append(dense)
            both += mark[0] @ mark[1].T
        linked = (100 * both >= SIMILARITY * (size_a[:, None] + size_b[None, :] - both)) & (ca[:, None] != cb[None, :])
        r, c = np.nonzero(linked)
        _, once = np.unique(np.stack([r, cb[c]]), axis=1, return_index=True) if len(r) else (None, np.zeros(0, int))
        a, b = na[r[once]], nb[c[once]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    keys = ["pivot", "x", "y"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _other_pairs(lists: DataFrame, pivots: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): members outside the main component of a list and the members of its other components,
    as far as their sketches agree and they do not match the same leader. A pair comes out of one list
    only: that of the least token which both have (as they are in different components, all lists they
    share are mixed)."""
    tokens = lists.groupBy("node").agg(F.collect_list("token").alias("tokens"))  # at most PREFIX
    member = lists.join(classes.select("node", "n_shingles", "sketch"), "node").join(tokens, "node").join(pivots, "node", "left")
    member = written(member, "mixed-members")
    side = lambda c: member.select(
        F.col("token").alias(f"t_{c}"), "main", F.col("node").alias(c), F.col("component").alias(f"c_{c}"), F.col("n_shingles").alias(f"n_{c}"),
        F.col("sketch").alias(f"s_{c}"), F.col("tokens").alias(f"l_{c}"), F.col("pivot").alias(f"p_{c}"))
    x, y = side("a").filter("c_a <> main"), side("b").drop("main")
    once = (F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b"))
    apart = (F.col("c_a") != F.col("c_b")) & F.coalesce(F.col("p_a") != F.col("p_b"), F.lit(True))
    near = apart & once & _sizes_fit("n_a", "n_b") & (_apart_bits("s_a", "s_b") <= MOST_APART)
    here = F.array_min(F.array_intersect("l_a", "l_b")) == F.col("t_a")
    return x.join(y, (F.col("t_a") == F.col("t_b")) & near & here).select(*_ordered("a", "b"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Components (node, component) of the links between classes (node, n_shingles, signature, sketch);
    None without links. Pairs are left out only if both are in one component already."""
    lists = written(posted(classes), "postings")
    known = _Links(docs, classes)
    led = written(_leaders(lists), "leaders")
    matching = written(_matching(led.select(*_ordered("node", "leader")).distinct(), classes), "matching-pairs")
    if matching.isEmpty():
        pivots = led.select("node", F.col("leader").alias("pivot")).limit(0)
    else:
        known.test(matching)
        own = led.select("node", "leader", *_ordered("node", "leader")).join(matching, ["a", "b"])
        heads = own.select(F.col("leader").alias("node"), F.col("leader").alias("pivot")).distinct()
        rest = own.select("node", F.col("leader").alias("pivot")).join(heads.select("node"), "node", "left_anti")
        pivots = written(heads.unionByName(rest), "pivots")
        stars = known.labelled(pivots).join(classes.select("node", "n_shingles"), "node")
        known.add(_star_links(stars, known.sets))
    mixed = known.mixed(lists)
    if not mixed.isEmpty():
        more = written(_matching(_other_pairs(mixed, pivots, classes), classes), "matching-pairs")
        if not more.isEmpty():
            known.test(more)
    return known.labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked from a similarity of 0.75 on; component_id is the smallest doc_id that links
    reach, kept says whether that is the document itself. NULL and empty texts have an empty set and
    are linked with nothing. Rows that share a doc_id must have the same text, or the component is
    that of the row with the smallest digest; a NULL doc_id is its own component, of NULL. Other
    columns are ignored.
    """
    own = written(signed(docs), "signatures")
    full = own.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    one = F.min(F.struct("doc_id", "n_shingles", "signature", "sketch")).alias("m")
    classes = full.groupBy("digest").agg(one).select("digest", F.col("m.doc_id").alias("node"), "m.n_shingles", "m.signature", "m.sketch")
    classes = written(classes, "classes")
    labels = links(docs, classes)
    named = classes.select("digest", F.col("node").alias("component"))
    if labels is not None:
        named = written(_labelled(classes.select("digest", "node"), labels, "node", "component").select("digest", "component"), "class-components")
    out = own.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less all but the smallest doc_id of each group of near
    duplicates. Of rows with the same doc_id and text one stays; rows without doc_id stay. Different
    texts under one doc_id are told apart: only those that are near duplicates go."""
    # Ids that occur once tell rows apart exactly; where ids repeat, id and text do, by their hash.
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    row = F.col("doc_id").cast("long") if again.isEmpty() else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", text_or_empty("text")))
    row = row.alias("_row")
    keyed = docs.select("*", row)
    found = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    found = written(found, "near-duplicates")
    known = found.distinct().join(keyed.select("_row", "doc_id"), "_row")
    stay = known.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("m")).select("m._row")
    gone = written(found.select("_row").distinct().join(stay, "_row", "left_anti"), "near-duplicates-gone")
    out = keyed.join(gone, "_row", "left_anti").select(*docs.columns)
    repeated = found.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
