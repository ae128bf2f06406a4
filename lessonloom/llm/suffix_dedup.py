"""Suffix-array dedup by column-wise construction over many documents.

Every byte covered by a 50-byte string that also starts in a document with a smaller
id is removed. The corpus is cut so that equal 50-byte windows meet in one place:

1. Each window names its least 20-byte run (by hash). Runs that occur in one document
   only cannot lie in a shared window; an exchange of packed keys (see ``chunks``)
   leaves the windows whose run occurs in two documents or more.
2. Neighbouring windows with the same run make one piece (50 to 80 bytes). Pieces go
   to the bucket of their run, each distinct piece of a chunk once, with the least and
   the greatest id that hold it. The windows of a very common run are pieces of their
   own and go by their whole content, so that no bucket grows with a common run.
3. In a bucket, pieces are the documents of a column-wise construction: each round
   inserts one symbol per piece into the sorted collection, right to left. Where a
   suffix goes follows from the collection's Burrows-Wheeler transform alone, and its
   common prefixes from those between the two places of its symbol in the transform;
   texts are not compared. Rounds are as many as the longest piece has bytes. Transform
   and prefixes are two sequences that each round reads and rewrites front to back; as
   a bucket's collections are bounded, they lie in memory, not in files of one machine.
4. Places in the sorted collection with a common prefix of 50 bytes or more are equal
   windows; the least id among them goes back to the chunks that hold the pieces.

What is filtered before the construction: texts that equal one with a smaller id (they
are covered as a whole, so a group of copies costs one document), texts under 50 bytes,
and windows whose least run no other document has. What windows are equal is decided by
the construction.

Defined results: a null or empty text has 0 bytes; texts under 50 bytes keep all; a
null doc_id counts as greater than all others and stays null; rows of one id are one
document to each other (neither has the smaller id); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm.chunks import ASKED, HOT, SLICE_BYTES, TWICE, answer, ask, by_bucket, chunked, count_keys, documents_of, groups_of, places, told_of, with_answers
from lessonloom.llm.common import BYTE_CODE, BYTES, Powers, back_to_null, cover, marked_runs, mix, read_documents, sliding_min, small_side

LENGTH = 50
RUN = 20
#: A run in at least so many documents is common: its windows go by their whole content.
COMMON = 4096
#: Pieces that one collection takes in, unless one run alone has more.
COLLECTION = 4096
#: A second hash of bytes, of another base.
CONFIRM = Powers(0xC2B2AE3D27D4EB4F)
END = 255  # no byte of UTF-8 text


# --- the construction -------------------------------------------------------------


def least_between(values: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Least of values[since:until] of each pair, none of them empty; the cost is that of the ranges together."""
    if not len(since):
        return np.empty(0, values.dtype)
    by = np.argsort(-since)  # from the back, as reduceat also reduces what lies between one range and a later one
    pairs = np.empty(2 * len(by), np.int64)
    pairs[::2], pairs[1::2] = since[by], until[by]
    out = np.empty(len(by), values.dtype)
    out[by] = np.minimum.reduceat(np.append(values, values[-1:]), pairs)[::2]
    return out


def sort_column_wise(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection: (bwt symbol, common prefix with the one before, up to depth).

    Round j adds the suffix of length j of every string that has one. Suffixes that begin
    with a symbol stand in the order of that symbol in the transform, after the empty
    ones; the k-th symbol of the transform in that order stands before the k-th suffix.
    Two neighbours there share the symbol and what the suffixes behind it share: the
    least prefix between the symbol's two places.
    """
    n, ends = len(starts), starts + lengths
    table = flat[ends - 1].astype(np.uint16)  # prefix in the high byte, symbol in the low one
    at, who = np.arange(n), np.arange(n)  # places of the latest suffixes, in order, and their strings
    for j in range(1, int(lengths.max()) + 1):
        if (short := lengths[who] < j).any():
            at, who = at[~short], who[~short]
        bwt = table.astype(np.uint8)
        order = np.argsort(bwt, kind="stable")
        due = np.zeros(len(bwt), bool)
        due[at] = True
        rank = np.flatnonzero(due[order])
        who, to, total = who[np.argsort(bwt[at], kind="stable")], n + rank, len(bwt) + len(rank)
        # Places that are new, and those whose neighbour before is.
        after = rank + 1
        k = np.concatenate((rank, after[(np.append(rank[1:], -1) != after) & (after < total - n)]))
        this, last = order[k], order[np.maximum(k - 1, 0)]
        some = np.flatnonzero((bwt[this] == bwt[last]) & (k > 0))
        value = np.zeros(len(k), np.uint16)
        value[some] = np.minimum((least_between(table, last[some] + 1, this[some] + 1) >> 8) + 1, depth) << 8
        old = np.ones(total, bool)
        old[to] = False
        wider = np.empty(total, np.uint16)
        wider[old] = table
        wider[to] = value[: len(rank)] | np.where(lengths[who] > j, flat[np.maximum(ends[who] - j - 1, 0)], END)
        later = n + k[len(rank) :]
        wider[later] = value[len(rank) :] | (wider[later] & 0xFF)
        table, at = wider, to
    return table.astype(np.uint8), (table >> 8).astype(np.uint8)


def suffixes_of(bwt: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, suffix length) at every place of a collection, 0 for suffixes shorter than ``least``: each string is followed through the transform."""
    n = len(lengths)
    before = np.empty(len(bwt), np.int64)  # where the suffix stands that is longer by the symbol of a place
    before[np.argsort(bwt, kind="stable")] = n + np.arange(len(bwt))
    string, size = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.uint8)
    at, who = np.arange(n), np.arange(n)
    for j in range(1, int(lengths.max()) + 1):
        live = lengths[who] >= j
        at, who = before[at[live]], who[live]
        if j >= least:
            string[at], size[at] = who, j
    return string, size


def least_ids(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, least id of all strings that hold the window of ``depth`` bytes at that offset), for every window."""
    bwt, prefix = sort_column_wise(flat, starts, lengths, depth)
    string, size = suffixes_of(bwt, lengths, depth)
    group = np.cumsum(prefix < depth)
    keep = np.flatnonzero(size)
    string, offset, group = string[keep], lengths[string[keep]] - size[keep], group[keep]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(ids[string], first)
    return string, offset, np.repeat(least, np.diff(np.append(first, len(group))))


# --- windows, runs and pieces of a chunk ------------------------------------------


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, document): stretches of windows with the same least run, each no longer than windows can share one run.

    Documents (each of ``length`` bytes or more) lie one after another in data; no window crosses an end.
    """
    most = length - run + 1
    least = sliding_min(BYTES.windows(BYTE_CODE[data], run), most)
    over = ends - length + 1  # the windows from here to the next document cross its end
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[over[:-1]] = new[ends[:-1]] = True
    new = np.flatnonzero(new)
    count = np.diff(np.append(new, len(least)))
    docs = np.searchsorted(ends, new, "right")
    inside = new < over[docs]
    new, count, docs = new[inside], count[inside], docs[inside]
    key = mix(least[new])
    if count.max() > most:
        parts = -(-count // most)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        new, key, docs, count = np.repeat(new, parts) + at * most, np.repeat(key, parts), np.repeat(docs, parts), np.minimum(np.repeat(count, parts) - at * most, most)
    return key, new, count, docs


class Chunk:
    """The documents of a chunk that are no copies, with the runs of their windows."""

    def __init__(self, table: pa.Table, copies: set, length: int, run: int):
        self.length = length
        self.ids, self.number, bodies = [], [], []
        for k, (name, tag, body) in enumerate(documents_of(table)):
            if len(body) >= length and (name, tag) not in copies:
                self.ids.append(name), self.number.append(k), bodies.append(body)
        self.ids, self.sizes = np.array(self.ids, np.int64), np.array(list(map(len, bodies)), np.int64)
        self.flat = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum(self.sizes)
        # Whole documents, some half a megabyte at a time.
        cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES, prepend=-1, append=-1))
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            base = int(ends[a] - self.sizes[a])
            key, start, count, docs = runs_of(self.flat[base : ends[b - 1]], ends[a:b] - base, length, run)
            parts.append((key, start + base, count, docs + a))
        none = [np.empty(0, kind) for kind in (np.uint64, np.int64, np.int64, np.int64)]
        self.keys, self.starts, self.counts, self.docs = map(np.concatenate, zip(*parts)) if parts else none

    def asked(self):
        """Keys of the runs, counted by document."""
        order, at = groups_of(self.keys, self.docs)
        return count_keys(self.keys[order[at]])

    def pieces(self, answers: pa.Table, buckets: int):
        """(route, content hash, start, bytes, document) of all pieces that may repeat."""
        asked = self.asked()
        told = told_of(asked, answers, buckets)
        mine = told[np.searchsorted(asked[0], self.keys)] if len(self.keys) else np.empty(0, np.uint8)
        rare, common = np.flatnonzero(mine == TWICE), np.flatnonzero(mine == HOT)
        start, size, docs, route = self.starts[rare], self.counts[rare] + self.length - 1, self.docs[rare], self.keys[rare]
        times = self.counts[common]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        single = np.repeat(self.starts[common], times) + offset
        start = np.concatenate((start, single))
        size = np.concatenate((size, np.full(len(single), self.length)))
        docs = np.concatenate((docs, np.repeat(self.docs[common], times)))
        coded = BYTE_CODE[self.flat]
        content = mix(BYTES.spans(coded, start, start + size) + size.astype(np.uint64)) if len(start) else np.empty(0, np.uint64)
        # a common run says little of its windows: they are told apart by two hashes, each over all their bytes
        start_common = start[len(rare) :]
        other = mix(CONFIRM.spans(coded, start_common, start_common + self.length)) if len(single) else np.empty(0, np.uint64)
        route = np.concatenate((route, other))
        return route, content, start, size, docs

    def distinct(self, route, content, docs):
        """Order by (route, content), the first place of each distinct piece in it, and its least and greatest id."""
        order, at = groups_of(route, content)
        ids = self.ids[docs[order]]
        return order, at, (np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)) if len(at) else (ids, ids)


SENT = "chunk int, bucket int, route binary, content binary, size binary, low binary, high binary, flat binary"


def send(chunk: int, c: Chunk, answers: pa.Table, buckets: int) -> pa.Table:
    """The distinct pieces of a chunk, one row a bucket."""
    route, content, start, size, docs = c.pieces(answers, buckets)
    order, at, (low, high) = c.distinct(route, content, docs)
    one = order[at]
    route, content, start, size = route[one], content[one], start[one], size[one]
    edges = places(route, buckets)
    some = np.flatnonzero(np.diff(edges))
    rows = {x.split()[0]: [] for x in SENT.split(", ")}
    for b in some:
        s = slice(edges[b], edges[b + 1])
        n = size[s]
        place = np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for name, v in zip(rows, (chunk, int(b), route[s].tobytes(), content[s].tobytes(), n.astype(np.uint8).tobytes(), low[s].tobytes(), high[s].tobytes(), c.flat[place].tobytes())):
            rows[name].append(v)
    return pa.table({k: pa.array(v, pa.int32() if k in ("chunk", "bucket") else pa.binary()) for k, v in rows.items()})


TOLD = "chunk int, bucket int, which binary, since binary, until binary, least binary"


def construct(table: pa.Table, length: int) -> pa.Table:
    """For one bucket: where windows of each chunk's pieces have a smaller id than the greatest that holds the piece there."""
    get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    routes = get("route", np.uint64)
    counts = [len(r) for r in routes]
    route, content = np.concatenate(routes), np.concatenate(get("content", np.uint64))
    size = np.concatenate(get("size", np.uint8)).astype(np.int64)
    low, high = np.concatenate(get("low", np.int64)), np.concatenate(get("high", np.int64))
    flat = np.concatenate(get("flat", np.uint8))
    start = np.cumsum(size) - size
    order, at = groups_of(route, content)
    piece = np.empty(len(order), np.int64)
    piece[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    one = order[at]
    least_id = np.minimum.reduceat(low[order], at)
    # Collections: whole routes, about COLLECTION pieces each.
    new_route = np.concatenate(([True], route[one][1:] != route[one][:-1]))
    route_at = np.flatnonzero(new_route)
    cuts = route_at[np.concatenate(([True], route_at[1:] // COLLECTION != route_at[:-1] // COLLECTION))]
    found = []
    for a, b in zip(cuts, np.append(cuts[1:], len(one))):
        n = size[one[a:b]]
        place = np.repeat(start[one[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        string, offset, least = least_ids(flat[place], np.cumsum(n) - n, n, least_id[a:b], length)
        by = np.lexsort((offset, string))
        string, offset, least = string[by] + a, offset[by], least[by]
        edge = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (least[1:] != least[:-1]))))
        found.append((string[edge], offset[edge], offset[np.append(edge[1:], len(string)) - 1], least[edge]))
    owner, since, until, least = map(np.concatenate, zip(*found))
    head = np.searchsorted(owner, np.arange(len(one) + 1))
    rows = {x.split()[0]: [] for x in TOLD.split(", ")}
    begin = 0
    for k, n in enumerate(counts):
        mine = piece[begin : begin + n]
        times = head[mine + 1] - head[mine]
        place = np.repeat(head[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        which = np.repeat(np.arange(n), times)
        useful = least[place] < high[begin : begin + n][which]
        begin += n
        if useful.any():
            place, which = place[useful], which[useful]
            for name, v in zip(rows, (table.column("chunk")[k].as_py(), table.column("bucket")[k].as_py(), which.astype(np.uint32).tobytes(), since[place].astype(np.uint8).tobytes(), until[place].astype(np.uint8).tobytes(), least[place].astype(np.int64).tobytes())):
                rows[name].append(v)
    return pa.table({k: pa.array(v, pa.int32() if k in ("chunk", "bucket") else pa.binary()) for k, v in rows.items()})


# --- the operator -----------------------------------------------------------------

#: What comes back to a chunk: its copies (kind 0), what is told of its runs (1) and of its pieces (2).
BACK = "chunk int, kind int, bucket int, a binary, b binary, c binary, d binary"
CUT = "id long, n_bytes long, n_removed long, spans array<struct<since:long,until:long>>, kept binary"


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


def copies_in(table: pa.Table) -> set:
    rows = of_kind(table, 0)
    return {(int(i), t[16 * k : 16 * k + 16]) for a, t in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()) for k, i in enumerate(np.frombuffer(a, np.int64))}


def told_runs(table: pa.Table) -> pa.Table:
    return of_kind(table, 1).rename_columns(["chunk", "kind", "bucket", "told", "b", "c", "d"])


def copies_of_smaller(docs: DataFrame) -> DataFrame:
    """One row a chunk: ids and tags of its documents whose whole text also has a smaller id, packed."""
    keyed = docs.select("chunk", "id", "tag")
    owners = keyed.groupBy("tag").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("tag", "owner")
    later = keyed.join(small_side(owners, 48), "tag").where("id > owner").select("chunk", "id", "tag").distinct()

    def pack(table: pa.Table) -> pa.Table:
        chunk, ids, tags = (table.column(c) for c in ("chunk", "id", "tag"))
        values = [[chunk[0].as_py()], [0], [0], [ids.to_numpy().astype(np.int64).tobytes()], [b"".join(tags.to_pylist())], [None], [None]]
        return pa.table({x.split()[0]: pa.array(v, pa.int32() if " int" in x else pa.binary()) for x, v in zip(BACK.split(", "), values)})

    return later.groupBy("chunk").applyInArrow(pack, BACK)


def remove_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, run: int = RUN, common: int = COMMON) -> DataFrame:
    """id (null as the last), n_bytes, n_removed, spans (removed, in bytes) and kept (the other bytes)."""
    rows, buckets = chunked(docs, id_col, text_col)
    copies = copies_of_smaller(rows)

    def ask_runs(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ask(0, count_keys(np.empty(0, np.uint64)), buckets)
        return ask(table.column("chunk")[0].as_py(), Chunk(table, copies_in(back), length, run).asked(), buckets)

    def tell_runs(table: pa.Table) -> pa.Table:
        t = answer(table, common)
        none = pa.nulls(t.num_rows, pa.binary())
        return pa.table({"chunk": t.column(0), "kind": pa.array(np.full(t.num_rows, 1), pa.int32()), "bucket": t.column(1), "a": t.column(2), "b": none, "c": none, "d": none})

    def send_pieces(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int32() if "int" in x else pa.binary()) for x in SENT.split(", ")})
        return send(table.column("chunk")[0].as_py(), Chunk(table, copies_in(back), length, run), told_runs(back), buckets)

    def tell_pieces(table: pa.Table) -> pa.Table:
        t = construct(table, length)
        return pa.table({"chunk": t.column(0), "kind": pa.array(np.full(t.num_rows, 2), pa.int32()), "bucket": t.column(1), "a": t.column(2), "b": t.column(3), "c": t.column(4), "d": t.column(5)})

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        if table.num_rows:
            copied = copies_in(back)
            c = Chunk(table, copied, length, run)
            removed = covered(c, told_runs(back), of_kind(back, 2), buckets, length)
            mine = dict(zip(c.number, removed))
            for k, (name, tag, body) in enumerate(documents_of(table)):
                data = np.frombuffer(body, np.uint8)
                gone = mine.get(k)
                if gone is None:
                    gone = np.full(len(data), len(data) >= length and (name, tag) in copied)
                since, until = marked_runs(gone)
                for column, v in zip(out.values(), (name, len(data), int(gone.sum()), [{"since": a, "until": b} for a, b in zip(since.tolist(), until.tolist())], data[~gone].tobytes())):
                    column.append(v)
        span = pa.list_(pa.struct([("since", pa.int64()), ("until", pa.int64())]))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()))})

    runs = by_bucket(with_answers(rows, copies, ask_runs, ASKED), buckets, tell_runs, BACK)
    known = copies.unionByName(runs)
    pieces = by_bucket(with_answers(rows, known, send_pieces, SENT), buckets, tell_pieces, BACK)
    return with_answers(rows, known.unionByName(pieces), cut, CUT)


def covered(c: Chunk, runs: pa.Table, told: pa.Table, buckets: int, length: int) -> list[np.ndarray]:
    """For each document of the chunk, the mask of the bytes to remove."""
    sizes = c.sizes
    if not len(sizes):
        return []
    route, content, start, _, docs = c.pieces(runs, buckets)
    order, at, _ = c.distinct(route, content, docs)
    edges = places(route[order[at]], buckets)
    upto = np.append(at, len(order))
    since, until = [], []
    for b, x, s, u, m in zip(*(told.column(k).to_pylist() for k in ("bucket", "a", "b", "c", "d"))):
        which = np.frombuffer(x, np.uint32).astype(np.int64) + edges[b]
        times = upto[which + 1] - upto[which]
        who = order[np.repeat(upto[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        since_at, until_at, least = (np.repeat(np.frombuffer(v, kind).astype(np.int64), times) for v, kind in ((s, np.uint8), (u, np.uint8), (m, np.int64)))
        smaller = least < c.ids[docs[who]]
        since.append(start[who[smaller]] + since_at[smaller])
        until.append(start[who[smaller]] + until_at[smaller] + length)
    gone = cover(int(sizes.sum()), np.concatenate(since), np.concatenate(until)) if since else np.zeros(int(sizes.sum()), bool)
    return np.split(gone, np.cumsum(sizes)[:-1])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_shared(read_documents(spark, sf_dir))
    return cut.select(back_to_null("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
