"""Exact Jaccard join of documents over their word shingles with a token-group matrix.

A document is the set of its distinct shingles of ``SHINGLE`` words, two documents link at a Jaccard similarity of
``THRESHOLD`` percent or more. Shingles are compared by 64-bit hashes, whole sets by 128-bit digests.

1. Documents with equal sets are one node, whatever their number.
2. A node that links with another shares at least ``THRESHOLD`` percent of its shingles with other nodes. Half of the hash
   range is dealt out by shingle, shared shingles are counted for each node, and nodes that can't reach that are out.
3. The rest are partitioned into groups of similar documents: nodes with a common min-hash key are compared with two
   centres of their bucket, and those that link are one group.
4. The matrix holds each group's union of shingles. A node (of the smaller group) opens a group only if a shingle
   is in the prefixes of both, if bit signatures allow the link, and if its overlap with the group's union reaches what a
   link needs.
5. Opened groups are compared with their queries in blocks, so a group of any size is split. One link between a query
   and a block is enough to join their components; all members of a group are in one component already.

Links between equal sets and links inside a group are never written out as pairs. No step drops, caps or samples candidates.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle of its own; repeated rows are copies; a null id is never the smallest, and a component
without any id has a null one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, give_back, let_go, map_texts, saved
from .components import components

SHINGLE = 5
THRESHOLD = 75
KEYS = 3  # min-hash keys, each of two minima
SLICE_TOKENS, SLICE_DOCS = 1 << 20, 60_000
BUCKET_TOKENS = 2_000_000
BLOCK_NODES, BLOCK_TOKENS = 2_000, 1_000_000
SIGNATURE = 1_024
DEAL_ROWS = 200_000  # rows of a task that compares prefixes
#: A shingle of so many sets of a slice, and of one in so many of them, is counted by its sets and not by itself.
HOT_SETS, HOT_SHARE = 64, 256

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], "u8")
_HALF = np.uint64(1 << 63)
_SHIFT = np.uint64(29)


@lru_cache(1)
def _hash_of_word() -> Callable[[bytes], int]:
    return Cache(xxhash.xxh3_64_intdigest, 150_000).__getitem__


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, "u8")
    hashes = np.fromiter(map(_hash_of_word(), words), "u8", len(words))
    parts = min(length, len(words))
    many = len(words) - parts + 1
    mixed = np.full(many, parts, "u8")
    # In place, and sorted once: this runs over every text, several times.
    for k in range(parts):
        mixed ^= hashes[k : many + k]
        mixed *= _ODD[0]
        mixed ^= mixed >> _SHIFT
    mixed *= _ODD[1]
    mixed.sort()
    fresh = np.ones(many, bool)
    np.not_equal(mixed[1:], mixed[:-1], out=fresh[1:])
    return mixed[fresh]


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _keys(found: np.ndarray) -> list[int]:
    """Min-hash keys: two minima each, under different mixes of the hashes."""
    turned = found ^ (found >> np.uint64(32))
    least = [int((turned * odd ^ (turned >> np.uint64(29)) * _ODD[(k + 1) % len(_ODD)]).min()) for k, odd in enumerate(_ODD)]
    return [xxhash.xxh3_64_intdigest(f"{k} {least[2 * k]} {least[2 * k + 1]}".encode()) - (1 << 63) for k in range(KEYS)]


def _needed(n: str, threshold: int) -> str:
    """SQL: shingles a document of ``n`` must have in common with one that it links with."""
    return f"(({n} * {threshold} + 99) div 100)"


def sketch(docs: DataFrame, doc_id: str, text: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, more, digest, n, n_half) of every row: its set, the set's size and how many of it lie in the lower half."""

    def start():
        let_go()

        def handle(t):
            found = shingles(t)
            return (digest(found) if len(found) else None, len(found), int(np.searchsorted(found, _HALF)))

        return handle

    return map_texts(docs, [doc_id, *more], text, start, "digest binary, n long, n_half long").withColumnRenamed(doc_id, "doc_id")


def _table(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def shared_counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(short, shared): for each node, by the first 8 bytes of its digest, how many of its lower-half shingles others have.

    Shingles are dealt out in buckets. One that many sets of a slice have is known to be shared: it goes with each of these
    sets, as a pair, to where the set's counts are added up, and only its name goes to its bucket. There, other slices'
    sets that have it become pairs too, so that equal pairs count once and no bucket holds all sets of a hot shingle.
    """

    def by_part(nodes: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Distinct pairs of a node and a hot shingle, by the part that adds up the node's counts."""
        part = nodes % buckets
        by = np.lexsort((ids, nodes, part))
        nodes, ids, part = nodes[by], ids[by], part[by]
        fresh = np.append(True, (nodes[1:] != nodes[:-1]) | (ids[1:] != ids[:-1]))[: len(by)]
        nodes, ids, part = nodes[fresh], ids[fresh], part[fresh]
        cuts = np.flatnonzero(np.diff(part)) + 1
        return [(int(p[0]), n, i) for p, n, i in zip(*(np.split(x, cuts) for x in (part, nodes, ids))) if len(p)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sets: list[np.ndarray] = []
        names: list[int] = []

        def dealt() -> pa.RecordBatch:
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            bucket = (tokens % np.uint64(buckets)).astype("i4")
            token = (tokens >> np.uint64(31)).astype("<u4")
            named = np.array(names, "i8")
            _, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
            hot = (times >= max(HOT_SETS, len(sets) // HOT_SHARE))[which]
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            rows: list[list] = [[], [], [], [], []]
            for every in np.split(by, cuts):
                own = every[~hot[every]]
                # The owners stay in order, so those of a bucket are numbered anew by their first place.
                firsts = np.append(True, owner[own][1:] != owner[own][:-1])[: len(own)]
                values = (
                    int(bucket[every[0]]),
                    named[owner[own][firsts]].tobytes(),
                    (np.cumsum(firsts) - 1).astype("<u2").tobytes(),
                    token[own].tobytes(),
                    np.unique(token[every[hot[every]]]).tobytes(),
                )
                for column, value in zip(rows, values):
                    column.append(value)
            at = np.flatnonzero(hot)
            for part, nodes, ids in by_part(named[owner[at]], bucket[at].astype("u8") << np.uint64(32) | token[at]):
                values = (-1 - part, nodes.tobytes(), b"", ids.tobytes(), b"")
                for column, value in zip(rows, values):
                    column.append(value)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["bucket", "nodes", "owner", "tokens", "hot"])

        let_go()
        held = 0
        for batch in batches:
            for t in batch.column(0):
                found = shingles(t.as_py())
                key = digest(found)
                if not len(found) or key in seen:
                    continue  # an equal set of this task has told the same already
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                found = found[: np.searchsorted(found, _HALF)]
                if len(found):
                    sets.append(found)
                    names.append(_short(key))
                    held += len(found)
                if held >= SLICE_TOKENS or len(sets) >= SLICE_DOCS:
                    yield dealt()
                    sets.clear(), names.clear()
                    held = 0
        if sets:
            yield dealt()
        sets.clear(), seen.clear()
        give_back()

    def count(bucket: pa.Table) -> pa.Table:
        """For each node of a bucket, how many of its shingles another node has, and its pairs; rows for each part of the nodes."""

        def joined(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(v, kind) for v in bucket.column(name).to_pylist()]

        lists, number = joined("nodes", "i8"), bucket.column("bucket")[0].as_py()
        columns = (("part", "nodes", "n", "ids"), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))
        if number < 0:  # pairs that are on their way
            return _table([(p, n.tobytes(), b"", i.tobytes()) for p, n, i in by_part(np.concatenate(lists), np.concatenate(joined("tokens", "u8")))], *columns)
        names, place = np.unique(np.concatenate(lists), return_inverse=True)
        owner = np.concatenate([own + start for own, start in zip(joined("owner", "<u2"), np.cumsum([0, *map(len, lists)]))])
        # A shingle and its node in one number; an equal set that several tasks have told shows as equal numbers.
        key = np.unique(np.concatenate(joined("tokens", "<u4")).astype("u8") << np.uint64(32) | place[owner].astype("u8"))
        token = key >> np.uint64(32)
        same = token[1:] == token[:-1]
        shared = (np.append(False, same) | np.append(same, False)).astype(bool)[: len(key)]
        own = (key & np.uint64(0xFFFFFFFF)).astype("i8")
        hot = np.isin(token, np.unique(np.concatenate(joined("hot", "<u4"))))
        n = np.bincount(own[shared & ~hot], minlength=len(names))
        part = names % buckets
        rows = [(int(k), names[own].tobytes(), n[own].astype("<i4").tobytes(), b"") for k in np.unique(part[n > 0]) for own in [(part == k) & (n > 0)]]
        pairs = by_part(names[own[hot]], np.uint64(number) << np.uint64(32) | token[hot])
        return _table(rows + [(p, n.tobytes(), b"", i.tobytes()) for p, n, i in pairs], *columns)

    def add_up(part: pa.Table) -> pa.Table:
        nodes, n, ids = (part.column(c).to_pylist() for c in ("nodes", "n", "ids"))
        paired = [np.empty(0, "i8"), *(np.frombuffer(v, "i8") for v, i in zip(nodes, ids) if i)]
        pairs = by_part(np.concatenate(paired), np.concatenate([np.empty(0, "u8"), *(np.frombuffer(i, "u8") for i in ids if i)]))
        lists = [np.frombuffer(v, "i8") for v, i in zip(nodes, ids) if not i] + [own for _, own, _ in pairs]
        counts = [np.frombuffer(v, "<i4") for v, i in zip(n, ids) if not i] + [np.ones(len(own), "<i4") for _, own, _ in pairs]
        names, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts))
        return pa.table({"short": pa.array(names), "shared": pa.array(total.astype("i8"))})

    dealt = docs.select(F.col(text).cast("string")).mapInArrow(deal, "bucket int, nodes binary, owner binary, tokens binary, hot binary")
    counted = dealt.groupBy("bucket").applyInArrow(count, "part int, nodes binary, n binary, ids binary")
    return counted.groupBy("part").applyInArrow(add_up, "short long, shared long")


def node_sets(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame) -> DataFrame:
    """(digest, n, tokens, keys) of the given nodes, from the text of one of their documents."""

    def start():
        def handle(t):
            found = shingles(t)
            return (digest(found), len(found), found.tobytes(), _keys(found)) if len(found) else (None, 0, None, None)

        return handle

    ids, own = nodes.select("rep").distinct(), docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    chosen = own.join(ids, own["_doc"].eqNullSafe(ids["rep"]), "left_semi")
    sets = map_texts(chosen, [], "_text", start, "digest binary, n long, tokens binary, keys array<long>")
    # An id that repeats can bring other texts with it, and the same one twice.
    return sets.join(nodes.select("digest"), "digest", "left_semi").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "keys")))


def _linked(pairs: DataFrame, threshold: int) -> DataFrame:
    """Those of (a, b, a_tokens, b_tokens) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for pair in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[pair].as_buffer(), "u8") for k in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a binary, b binary")


def group_links(sets: DataFrame, threshold: int) -> DataFrame:
    """Links of nodes with the two centres (smallest and largest digest) of each of their min-hash buckets."""
    keyed = sets.select("digest", "n", F.explode("keys").alias("key"))
    centres = keyed.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    pairs = keyed.join(centres, "key").select(F.col("digest").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    of = sets.select("digest", "n", "tokens")
    left, right = (of.select(*(F.col(c).alias(x if c == "digest" else f"{x}_{c}") for c in of.columns)) for x in "ab")
    near = f"a_n >= {_needed('b_n', threshold)} and b_n >= {_needed('a_n', threshold)}"
    return _linked(pairs.join(right, "b").join(left, "a").where(near), threshold)


def _signatures(nodes: DataFrame) -> DataFrame:
    """(digest, signature): the parity of a set's hashes at each of ``SIGNATURE`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                spots = (np.frombuffer(tokens.as_buffer(), "u8") * _ODD[2]) >> np.uint64(64 - SIGNATURE.bit_length() + 1)
                rows.append((key, np.packbits(np.bincount(spots.astype("i8"), minlength=SIGNATURE) & 1 == 1).tobytes()))
            yield from _table(rows, ("digest", "signature"), (pa.binary(), pa.binary())).to_batches()

    return nodes.select("digest", "tokens").mapInArrow(run, "digest binary, signature binary")


#: What an entry is in the block that it is sent to.
_HELD, _ASKS, _BOTH = 0, 1, 2


def _candidates(prefix: DataFrame, queries: DataFrame, size: DataFrame, threshold: int) -> DataFrame:
    """(digest, n, target): groups that a query of a smaller group may link with.

    Nodes of different groups meet at each shingle that both have in their prefix, in blocks of ``BLOCK_NODES`` a side.
    Signatures that differ in d bits come from sets that differ in d shingles at least, which bounds the overlap.
    Only what passes that is given out, as pairs of a query and a group.
    """
    known = prefix.join(_signatures(queries), "digest").join(size.select("grp", "members"), "grp")
    blocks = prefix.groupBy("token").agg(F.expr(f"cast(1 + count(*) div {BLOCK_NODES} as int)").alias("blocks"))
    spot = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    known = known.join(blocks, "token").withColumn("spot", spot)
    # Of a shingle with one block each entry is sent once and is both asker and target, else once to every block on either side.
    every = "transform(sequence(0, blocks - 1), b -> struct({} as qb, {} as mb, {} as side))"
    places = F.expr(f"if(blocks = 1, array(struct(0 as qb, 0 as mb, {_BOTH} as side)), concat({every.format('spot', 'b', _ASKS)}, {every.format('b', 'spot', _HELD)}))")
    # Many shingles share a task; within it, those of one shingle and block pair are compared.
    sent = F.expr(f"if(c < {BLOCK_NODES}, c, 2 * c * (1 + c div {BLOCK_NODES}))")
    total = prefix.groupBy("token").agg(F.count("*").alias("c")).agg(F.sum(sent).alias("n")).first()["n"] or 0
    deals = max(4 * int(prefix.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + int(total) // DEAL_ROWS)
    rows = known.select("token", F.explode(places).alias("p"), "digest", "n", "grp", "members", "signature").select("token", "p.*", "digest", "n", "grp", "members", "signature")
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("token", "qb", "mb"), F.lit(deals)).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        names = table.column("digest").to_pylist()
        groups = table.column("grp").to_pylist()
        n, members, token, qb, mb, side = (table.column(c).to_numpy().astype("i8") for c in ("n", "members", "token", "qb", "mb", "side"))
        number, group = np.unique(np.array(groups, object), return_inverse=True)  # in the order of the group ids
        bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), "u8").reshape(len(names), -1)
        by = np.lexsort((mb, qb, token))
        edge = np.flatnonzero((np.diff(token[by]) != 0) | (np.diff(qb[by]) != 0) | (np.diff(mb[by]) != 0)) + 1
        found: set[tuple[bytes, int, int]] = set()
        for own in np.split(by, edge):
            targets, askers = own[side[own] != _ASKS], own[side[own] != _HELD]
            for q in askers:
                t = targets[(members[targets] > members[q]) | ((members[targets] == members[q]) & (group[targets] > group[q]))]
                apart = np.bitwise_count(bits[t] ^ bits[q]).sum(axis=1, dtype="i8")
                both = n[t] + n[q]
                # Twice the overlap is at most both - apart, and a link needs both * threshold / (100 + threshold) of it.
                t = t[(both - apart) * (100 + threshold) >= 2 * threshold * both]
                found.update((names[q], int(n[q]), g) for g in group[t].tolist())
        return _table([(q, size, number[g]) for q, size, g in found], ("digest", "n", "target"), (pa.binary(), pa.int64(), pa.binary()))

    return rows.groupBy("deal").applyInArrow(meet, "digest binary, n long, target binary").distinct()


def open_links(sets: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """Links between different groups, one for each query and block of an opened group that has any."""
    grouped = saved(sets.join(groups.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "n", "tokens", F.coalesce("root", "digest").alias("grp")), "grouped")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a row gives as many as it has shingles
                piece = batch.slice(at, 64)
                tokens = [np.frombuffer(t.as_buffer(), "i8") for t in piece.column(3)]
                owner = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                columns = [piece.column(k).take(owner) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(tokens))], ["digest", "n", "grp", "token"])

    def entries(of: DataFrame) -> DataFrame:
        return of.select("digest", "n", "grp", "tokens").mapInArrow(explode, "digest binary, n long, grp binary, token long")

    # Only shingles in several groups can take part, and only nodes that have enough of them.
    spread = entries(grouped).groupBy("token").agg(F.min("grp").alias("_low"), F.max("grp").alias("_high")).where("_low <> _high").select("token")
    able = entries(grouped).join(spread, "token", "left_semi").groupBy("digest").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(f"c >= {_needed('n', threshold)}")
    queries = saved(grouped.join(able.select("digest"), "digest", "left_semi"), "queries")
    matrix = saved(entries(queries), "matrix")
    union = matrix.select("token", "grp").distinct()
    held = union.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    several = saved(matrix.join(held, "token"), "several")

    # Shingles in one group come first in everyone's order and use up the prefix.
    by_rarity = Window.partitionBy("digest").orderBy("groups", "token")
    placed = several.withColumn("place", F.row_number().over(by_rarity)).withColumn("own", F.count("*").over(Window.partitionBy("digest")))
    prefix = saved(placed.where(f"place <= own - {_needed('n', threshold)} + 1").select("digest", "n", "grp", "token"), "prefix")
    size = queries.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("held"))
    candidates = saved(_candidates(prefix, queries, size, threshold), "candidates")

    overlap = candidates.join(several.select("digest", "token"), "digest").join(union.withColumnRenamed("grp", "target"), ["token", "target"])
    opened = overlap.groupBy("digest", "target").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(f"c >= {_needed('n', threshold)}").select("digest", "target")

    def blocks(nodes: str, tokens: str) -> F.Column:
        return F.expr(f"cast(1 + greatest({nodes} div {BLOCK_NODES}, {tokens} div {BLOCK_TOKENS}) as int)")

    def own(of: str) -> F.Column:
        return F.pmod(F.xxhash64("digest"), F.col(of)).cast("int")

    # A group is opened block by block: each block of queries meets each member block once.
    asking = saved(opened.join(queries.select("digest", "n", "tokens"), "digest"), "opened").withColumnRenamed("target", "grp")
    askers = asking.groupBy("grp").agg(blocks("count(*)", "sum(n)").alias("qs"))
    sizes = size.select("grp", blocks("members", "held").alias("ms")).join(askers, "grp")
    every = lambda of: F.explode(F.expr(f"sequence(0, {of} - 1)"))
    member = queries.join(sizes, "grp").select("grp", own("ms").alias("mb"), every("qs").alias("qb"), F.lit(False).alias("asks"), "digest", "tokens")
    query = asking.join(sizes, "grp").select("grp", every("ms").alias("mb"), own("qs").alias("qb"), F.lit(True).alias("asks"), "digest", "tokens")

    def compare(rows: pa.Table) -> pa.Table:
        asks = np.array(rows.column("asks").to_pylist())
        names, sets = rows.column("digest").to_pylist(), [np.frombuffer(t, "u8") for t in rows.column("tokens").to_pylist()]
        members = np.flatnonzero(~asks)
        found: list[tuple[bytes, bytes]] = []
        if len(members):
            tokens = np.concatenate([sets[m] for m in members])
            sizes = np.array([len(sets[m]) for m in members])
            owner = np.repeat(np.arange(len(members)), sizes)
            by = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[by], owner[by]
            for q in np.flatnonzero(asks):
                low, high = np.searchsorted(tokens, sets[q], "left"), np.searchsorted(tokens, sets[q], "right")
                times = high - low
                at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                common = np.bincount(owner[at], minlength=len(members))
                link = np.flatnonzero(100 * common >= threshold * (sizes + len(sets[q]) - common))
                if len(link):
                    found.append((names[q], names[members[link[0]]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return member.union(query).groupBy("grp", "mb", "qb").applyInArrow(compare, "a binary, b binary")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links lead to."""
    return rows_in_groups(docs, doc_id, text, threshold).select("doc_id", "n_shingles", "component_id")


def rows_in_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, more: tuple[str, ...] = ()) -> DataFrame:
    """As ``join``, with the columns ``more`` of each row and the digest that names its component, null without shingles."""
    spark = docs.sparkSession
    drawn = saved(sketch(docs, doc_id, text, more), "sketch")
    total = drawn.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + int(total) // (2 * BUCKET_TOKENS))
    nodes = drawn.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("n_half").alias("n_half"))
    nodes = saved(nodes.withColumn("short", F.expr("cast(conv(hex(substring(digest, 1, 8)), 16, -10) as bigint)")), "nodes")
    counts = shared_counts(docs, text, buckets)
    able = nodes.join(counts, "short", "left").where(f"coalesce(shared, 0) >= n_half - (n - {_needed('n', threshold)})")
    sets = saved(node_sets(docs, doc_id, text, saved(able.select("digest", "rep"), "able")), "sets")

    first = saved(group_links(sets, threshold), "group-links")
    groups = saved(components(first), "groups")
    second = saved(open_links(sets, groups, threshold), "open-links")
    # Stars of the groups stand for their links.
    stars = groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars.union(second))
    rooted = nodes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("root", "digest").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(least, "root").select("digest", "root", "component_id")
    return drawn.join(classes, "digest", "left").select(
        "doc_id", *more, F.col("root").alias("component"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
