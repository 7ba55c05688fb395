"""N-gram Jaccard self-join with token-combination prefixes.

A text is lower-cased (A-Z) and cut at ASCII white space. Its set holds hashes
of all runs of ``WORDS`` words; of fewer words, the whole run is the only
member; without words the set is empty and linked with nothing. Two documents
are linked when ``100 * |x & y| >= percent * |x | y|``.

1. **Frequencies.** Sets are cut by ranges of the hash. A task has all members
   of a range, counts in how many documents each is, and answers with those
   that are in two or more. Members of one document only cannot be shared, so
   the answers hold every intersection. Members travel packed, five bytes each.
2. **Prefixes.** All documents order members alike: those of one document
   first, then by class of frequency, then by hash. Linked documents share a
   member within the first ``p = |x| - ceil(t |x|) + 1``. A document whose
   first ``p`` members are its own alone has no link and is done.
3. **Combinations.** Equal sets are taken together. A rare member in the prefix
   is indexed alone. For frequent ones the prefix is extended by ``g`` members,
   so that linked documents share ``g + 1`` frequent ones (or a rare one), and
   pairs of members are indexed. Members are dealt to ``g`` boxes by hash: of
   ``g + 1`` two are in one box, so pairs within a box are enough, and their
   number grows with the length of the prefix, not with its square.
4. **Verification.** An entry knows how many members of a set come before it.
   If that is the first shared member, what is left of both sets must suffice
   for a link, or the pair is none of this entry. Within each entry all
   documents are checked against one (that with the fewest members of its
   own), links are joined into components, and then only pairs of an entry
   that are still in different components are checked. So a thousand near
   copies of one text cost a thousand checks, and no link between components
   is lost. There is no cap on entries, members or partners.

Null texts are empty. Rows with equal ids are separate documents; a component
is named by its smallest id. The result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERCENT = 75
#: Members in a range, about, and members that a task sends at once.
RANGE_MEMBERS = 1_000_000
BATCH_MEMBERS = 400_000
#: Bytes of text per member, about; only the number of ranges comes from it.
BYTES_PER_MEMBER = 6
#: Members in fewer than 2 ** RARE documents are indexed alone.
RARE = 6
#: Boxes for pairs: one for this many members of a set.
BOX = 16
LOW_BITS = 40


# --- packed members --------------------------------------------------------
def member_width(ranges: int) -> int:
    return (LOW_BITS + max(ranges - 1, 1).bit_length() + 7) // 8


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix of a set of ``n`` members."""
    return n - (percent * n + 99) // 100 + 1


# --- 1: frequencies --------------------------------------------------------
def text_sets(raw: np.ndarray, offsets: np.ndarray, table, powers, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of the sets of some texts, sorted by text and member, and text numbers."""
    own = common.Words(raw, offsets, table)
    hashes = own.hashes(powers)
    members = common.windows(hashes, words)
    inside = common.whole(own.first, words, len(hashes))
    doc = np.repeat(np.arange(len(offsets) - 1), own.counts())[: len(members)]
    members, doc = members[inside], doc[inside]
    counts = own.counts()
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            runs = common.windows(hashes, n)[own.first[short]]
            members = np.concatenate([members, common.mix64(runs ^ np.uint64(n))])
            doc = np.concatenate([doc, short])
    order = np.argsort(members)
    order = order[np.argsort(doc[order], kind="stable")]
    members, doc = members[order], doc[order]
    new = np.ones(len(members), bool)
    new[1:] = (members[1:] != members[:-1]) | (doc[1:] != doc[:-1])
    return members[new], doc[new]


SENT = "range int, batch long, counts binary, members binary, ids binary"


def _send(batches: Iterable[pa.RecordBatch], ranges: int, words: int) -> Iterator[pa.RecordBatch]:
    """For each batch of documents a row for each range, and one with the documents themselves."""
    from pyspark import TaskContext

    table, powers = common.folding(common.NOT_SPACE), common.Powers()
    batch_no = TaskContext.get().partitionId() << 20
    held: list[tuple] = []

    def rows() -> pa.RecordBatch:
        nonlocal batch_no, held
        n_docs = sum(len(h[2]) for h in held)
        shift = np.cumsum([0, *(len(h[2]) for h in held)])
        members = np.concatenate([h[0] for h in held])
        doc = np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
        numbers = [x for h in held for x in h[2]]
        hashes = np.concatenate([h[3] for h in held])
        size = np.bincount(doc, minlength=n_docs)
        first = np.cumsum(size) - size
        sums = [np.add.reduceat(np.append(x, np.uint64(0)), first) for x in (members, common.mix64(members))]
        sums = [np.where(size > 0, s, np.uint64(0)) for s in sums]
        facts = np.stack([size.astype(np.uint64), *sums, hashes.astype(np.uint64)]).astype("<u8").tobytes()
        ids = np.array([0 if x is None else x for x in numbers], "<i8").tobytes()
        ids += np.array([x is None for x in numbers], np.uint8).tobytes()
        out = [(-1 - batch_no % ranges, batch_no, facts, b"", ids)]
        # members of a document are sorted, so those of one range stand together
        of = ((members >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(of.astype(np.int32), kind="stable")
        edges = np.searchsorted(of[order], np.arange(ranges + 1))
        for r in range(ranges):
            some = order[edges[r] : edges[r + 1]]
            if len(some):
                counts = np.bincount(doc[some], minlength=n_docs).astype("<u4").tobytes()
                out.append((r, batch_no, counts, common.squeeze(members[some], LOW_BITS // 8), b""))
        batch_no, held = batch_no + 1, []
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["range", "batch", "counts", "members", "ids"])

    total = 0
    for batch in batches:
        raw, offsets = common.texts_buffer(batch.column(1))
        numbers, hashes = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi in common.chunks(offsets):
            own = offsets[lo : hi + 1] - offsets[lo]
            members, doc = text_sets(raw[offsets[lo] : offsets[hi]], own, table, powers, words)
            held.append((members, doc, numbers[lo:hi], hashes[lo:hi]))
            total += len(members) + hi - lo
            if total >= BATCH_MEMBERS:
                yield rows()
                total = 0
    if held:
        yield rows()


ANSWERED = "batch long, counts binary, members binary, classes binary, ids binary"


def _counter(width: int):
    return lambda key, table: _count(key[0].as_py(), table, width)


def _count(number: int, table: pa.Table, width: int) -> pa.Table:
    """The members of one range that are in two or more documents, for each batch."""
    names = ["batch", "counts", "members", "classes", "ids"]
    if number < 0:
        empty = pa.array([None] * len(table), pa.binary())
        columns = [table["batch"], table["counts"], table["members"], empty, table["ids"]]
        return pa.table(columns, names=names)
    low = [common.expand(x.as_py(), LOW_BITS // 8) for x in table["members"]]
    sizes = np.array([len(x) for x in low])
    members = np.concatenate(low)
    order = np.argsort(members)
    ordered = members[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    frequency = np.diff(np.append(first, len(ordered)))
    classes = np.zeros(len(members), np.uint8)
    classes[order] = np.repeat(np.frexp(frequency.astype(float))[1], frequency)
    members |= np.uint64(number << LOW_BITS)
    out = []
    for batch, counts, at, n in zip(table["batch"], table["counts"], np.cumsum(sizes) - sizes, sizes, strict=True):
        own = classes[at : at + n]
        shared = own > 1
        docs = np.frombuffer(counts.as_py(), "<u4")
        doc = np.repeat(np.arange(len(docs)), docs)[shared]
        left = np.bincount(doc, minlength=len(docs)).astype("<u4").tobytes()
        packed = common.squeeze(members[at : at + n][shared], width)
        out.append((batch.as_py(), left, packed, own[shared].tobytes(), None))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.table(columns, names=names)


# --- 2: prefixes -----------------------------------------------------------
SETS = "key long, doc_id long, text_hash long, n long, h1 long, h2 long, own int, rare int, members binary"


def _collect(percent: int, width: int):
    """The documents of a batch; members only where the prefix holds a shared one."""

    def collect(table: pa.Table) -> pa.Table:
        counts, members, classes = [], [], []
        for row in table.to_pylist():
            if row["ids"] is not None:
                facts = np.frombuffer(row["counts"], "<u8").reshape(4, -1)
                n_docs, ids, batch = facts.shape[1], row["ids"], row["batch"]
            else:
                counts.append(np.frombuffer(row["counts"], "<u4"))
                members.append(common.expand(row["members"], width))
                classes.append(np.frombuffer(row["classes"], np.uint8))
        doc = [np.repeat(np.arange(n_docs), c) for c in counts]
        doc, members, classes = (
            np.concatenate([*x, np.zeros(0, t)]) for x, t in ((doc, np.int64), (members, np.uint64), (classes, np.uint8))
        )
        n = facts[0].astype(np.int64)
        shared = np.bincount(doc, minlength=n_docs)
        own = n - shared
        stays = (n > 0) & (own < prefix(n, percent))
        some = stays[doc]
        doc, members, classes = doc[some], members[some], classes[some]
        order = np.lexsort((members, classes, doc))
        members, classes, doc = members[order], classes[order], doc[order]
        rare = np.bincount(doc[classes <= RARE], minlength=n_docs)
        edges = np.searchsorted(doc, np.arange(n_docs + 1))
        numbers = np.frombuffer(ids, "<i8", n_docs)
        null = np.frombuffer(ids, np.uint8, n_docs, 8 * n_docs).astype(bool)
        packed = [
            common.squeeze(members[a:b], width) if s else None
            for s, a, b in zip(stays.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]
        return pa.table(
            [
                pa.array((batch << 20) + np.arange(n_docs)),
                pa.array(numbers, pa.int64(), mask=null),
                pa.array(facts[3].view(np.int64)),
                pa.array(n),
                pa.array(facts[1].view(np.int64)),
                pa.array(facts[2].view(np.int64)),
                pa.array(own.astype(np.int32)),
                pa.array(rare.astype(np.int32)),
                pa.array(packed, pa.binary()),
            ],
            names=["key", "doc_id", "text_hash", "n", "h1", "h2", "own", "rare", "members"],
        )

    return collect


def sets(documents: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, int]:
    """The sets of all documents, and the bytes of a packed member."""
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(size // (BYTES_PER_MEMBER * RANGE_MEMBERS)) + 1
    width = member_width(ranges)
    sent = rows.mapInArrow(lambda it: _send(it, ranges, words), SENT)
    answers = sent.groupBy("range").applyInArrow(_counter(width), ANSWERED)
    return common.stage(answers.groupBy("batch").applyInArrow(_collect(percent, width), SETS), "sets"), width


# --- 3: combinations -------------------------------------------------------
def signatures(n: int, own: int, rare: int, members: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of one set: hashes of single rare members and of pairs of
    frequent ones; and how many members come before the first one shared with
    a set that is linked by this entry, at least."""
    p = int(prefix(np.int64(n), percent))
    alone = common.mix64(members[: max(0, min(p - own, rare))])
    place = own + np.arange(len(alone))
    if p - own <= rare or n < 2:
        return alone, place
    out = []
    largest = n * 100 // percent
    for scale in range(n.bit_length(), largest.bit_length() + 1):
        boxes = max(1, (1 << scale) // (2 * BOX))
        some = members[rare : max(p + boxes - own, 0)]
        box = common.mix64(some) % np.uint64(boxes)
        order = np.argsort(box, kind="stable")
        edges = np.searchsorted(box[order], np.arange(boxes + 1, dtype=np.uint64))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                x, y = np.triu_indices(b - a, 1)
                pair = np.sort(np.stack([some[order[a:b]][x], some[order[a:b]][y]]), axis=0)
                out.append(common.mix64(common.mix64(pair[0]) + pair[1] * np.uint64(3) + np.uint64(scale)))
    pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *out]))
    return np.concatenate([alone, pairs]), np.concatenate([place, np.full(len(pairs), own + len(alone))])


def _index(percent: int, width: int):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members = common.expand(row["members"], width)
                own, place = signatures(row["n"], row["own"], row["rare"], members, percent)
                k = len(own)
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own.view(np.int64)),
                            pa.array(np.full(k, row["key"])),
                            pa.array(np.full(k, row["n"])),
                            pa.array(place),
                            pa.array(np.full(k, row["own"])),
                        ],
                        ["entry", "key", "n", "place", "own"],
                    )

    return index


# --- 4: verification -------------------------------------------------------
def verified(pairs: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``a``, ``b`` that are linked, by their whole sets."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, n, m = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "x", "y", "n", "m"))
            keep = []
            for u, v, size in zip(x, y, (n.to_numpy() + m.to_numpy()).tolist(), strict=True):
                both = np.concatenate([common.expand(u.as_buffer(), width), common.expand(v.as_buffer(), width)])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (size - same))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = members.select(F.col("key").alias("a"), F.col("members").alias("x"), "n")
    right = members.select(F.col("key").alias("b"), F.col("members").alias("y"), F.col("n").alias("m"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")
    return common.stage(joined.mapInArrow(check, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``key`` and the smallest key reachable, for every end of a link.

    Alternating star contraction: all neighbours above a node are linked to its
    smallest neighbour, then all below it, until nothing changes. The number of
    rounds grows with the logarithm of the longest chain.
    """
    edges, before = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")), None
    while True:
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = common.stage(small, "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
        before = state


def linked_components(documents: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple:
    """The sets of all documents, and the components of those that have links or equal sets."""
    all_sets, width = sets(documents, doc_id, text, words, percent)
    same = ["n", "h1", "h2"]
    shared = all_sets.filter("members is not null")
    first = shared.groupBy(*same).agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    members = common.stage(
        shared.select("key", "n", "own", "rare", "members").join(first.select("key"), "key", "left_semi"), "members"
    )
    shape = "entry long, key long, n long, place long, own long"
    entries = common.stage(members.mapInArrow(_index(percent, width), shape), "entries")
    # the head of an entry: the document with the fewest members of its own, as the original of many copies
    heads = entries.groupBy("entry").agg(
        F.min(F.struct("own", "key", "n", "place")).alias("head"), F.count("*").alias("c")
    )
    heads = heads.filter("c > 1").select(
        "entry", F.col("head.key").alias("a"), F.col("head.n").alias("m"), F.col("head.place").alias("before")
    )
    # what both have from the first shared member on must be enough for a link
    near = F.expr(f"{100 + percent} * least(n - place, m - before) >= {percent} * (n + m)")
    crowd = common.stage(entries.join(heads, "entry").drop("own"), "crowd")
    stars = crowd.filter("key <> a").filter(near).select("a", F.col("key").alias("b")).distinct()
    links = verified(stars, members, percent, width)
    found = components(links)
    # entries whose documents are still in several components
    label = F.coalesce("component", "key").alias("c")
    named = crowd.join(found, "key", "left").select("entry", "key", "n", "place", "a", label)
    apart = named.groupBy("entry").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    named = common.stage(named.join(apart.select("entry"), "entry", "left_semi"), "open")
    other = named.select(
        "entry", F.col("key").alias("b"), F.col("n").alias("m"), F.col("place").alias("before"), F.col("c").alias("d")
    )
    rest = (
        named.join(other, "entry")
        .filter("key < b and c <> d and a <> key and a <> b")
        .filter(near)
        .select(F.col("key").alias("a"), "b")
        .distinct()
    )
    more = verified(rest, members, percent, width)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # from first documents of equal sets to all documents
    named_sets = first.join(found, "key", "left").select(*same, F.coalesce("component", "key").alias("component"))
    rows = shared.select("key", "doc_id", "text_hash", *same).join(named_sets, same)
    return all_sets, common.stage(rows.select("key", "doc_id", "text_hash", "n", "component"), "classes")


def join_classes(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """For each document ``doc_id``, ``n_shingles`` and ``component_id``, the
    smallest id that is reachable by links, its own included."""
    all_sets, classes = linked_components(documents, doc_id, text, words, percent)
    names = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = classes.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = all_sets.filter("members is null")
    return linked.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: Bits of the filter that spares most texts the shuffle; its size is fixed.
FILTER_BITS = 1 << 26


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash in ``hash``, in a table of ``FILTER_BITS``. At most
    one row for each of its 64-bit words reaches the driver."""
    word = F.shiftright(F.pmod("hash", F.lit(FILTER_BITS)), 6)
    bit = F.expr("shiftleft(1L, cast(pmod(hash, 64) AS INT))")
    found = hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def keep_first(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """The documents without those that are linked, over any number of steps,
    with one of a smaller id. Of rows with one id and one text, one stays.

    Documents that go are named by id and hash of the text. A filter of fixed
    size, broadcast, says which documents may be among them; only these are
    shuffled to meet the list, all others are kept where they are.
    """
    _, classes = linked_components(documents, doc_id, text, words, percent)
    first = classes.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    gone = classes.join(first, "component").filter(~same).select("doc_id", "text_hash").distinct()
    gone = common.stage(gone.withColumn("hash", F.xxhash64("doc_id", "text_hash")), "gone")
    # rows that stand more than once: one of them stays
    copies = classes.groupBy("component", "doc_id", "text_hash").count().filter("count > 1")
    copies = common.stage(copies.select(F.xxhash64("doc_id", "text_hash").alias("hash")), "copies")
    bits = documents.sparkSession.sparkContext.broadcast(filter_of(gone.select("hash").unionByName(copies)))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy() % FILTER_BITS
        return pd.Series((bits.value[at >> 6] >> (at & 63)) & 1 == 1)

    df = common.inner(documents)
    number, body = (f"_c{documents.columns.index(c)}" for c in (doc_id, text))
    df = df.withColumn("_h", F.xxhash64(body)).withColumn("_n", F.col(number).cast("long"))
    df = df.withColumn("_maybe", maybe(F.xxhash64("_n", "_h")))
    clear, doubtful = df.filter(~F.col("_maybe")), df.filter("_maybe")
    listed = doubtful["_n"].eqNullSafe(gone["doc_id"]) & (doubtful["_h"] == gone["text_hash"])
    kept = clear.unionByName(doubtful.dropDuplicates(["_n", "_h"]).join(gone, listed, "left_anti"))
    return kept.select(*common.outer(kept, documents.columns))
