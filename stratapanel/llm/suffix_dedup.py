"""Removal of repeated byte strings by suffix sorting.

Every byte goes that lies in a string of ``length`` bytes which also starts in a
document of smaller ``doc_id``.  Each such string is owned by one short gram
inside it: the least by hash of its grams of ``GRAM`` bytes, the leftmost of
equals, so equal strings have equal owners wherever they stand.  Neighbouring
strings of one owner form a fragment, about fourteen bytes longer than ``length``.

1. Owners met in two documents are found by sorting their hashes, bucket by
   bucket; only documents that hold one go on.
2. Their fragments are dealt out by owner.  Equal fragments count once, with
   their smallest document.  The rest of an owner's fragments are joined to one
   text and its suffixes are sorted in two stages: those smaller than their
   successors directly, the others by induction in bucket scans.  Where adjacent
   suffixes share ``length`` bytes or more, the smallest document of the run
   keeps the string and the others lose it.
3. Each document's spans are merged and cut out.

Every slice of a task sends an owner, and an equal fragment, once: with its
smallest document there; the others are decided on the spot.  So a passage that
most documents share costs one entry a slice.  What a bucket finds goes back
packed by destination, a group of documents, so rows do not multiply as buckets
times documents.  Work is on UTF-8 bytes, whole texts, never across documents.

Defined results: null texts are empty; texts shorter than ``length`` lose
nothing; rows with a null ``doc_id`` take no part; rows that repeat a
``doc_id`` keep what they share with each other and are cut one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, concatenated, slices
from stratapanel.llm.store import removed, width, written
from stratapanel.llm.words import _LETTER, _powers, mixed

#: Long enough that phrases of a few words own nothing in common.
GRAM = 24
#: Bytes of text whose owners or fragments one group of a shuffle holds about.
GROUP_TEXT = 4 << 20
#: Bytes of text whose findings (a few bytes each) one destination takes about.
SENT_TEXT = 64 << 20
#: Bytes of fragments whose suffixes are sorted at once (more, where one owner has more).
SORTED_BYTES = 1 << 19
#: Bytes of text that are looked through for fragments at once.
SLICE = 1 << 20
#: Bytes of text in which owners are looked for at once.
SEGMENT = 1 << 22


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h, span, factor = _LETTER[raw], 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        step = min(span, GRAM - span)  # the last halves overlap
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
        span, factor = span + step, (factor * 3 | 1) & (1 << 64) - 1
    return mixed(h)


def fragments(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, owner): the strings of ``length`` bytes that start from ``first`` to ``last`` share an owner.

    Positions are those of ``raw``; ``owner`` is the owning gram's hash.
    """
    reach = length - GRAM + 1
    out = []
    for begin in range(0, max(len(raw) - length + 1, 0), SEGMENT):
        part = raw[begin: begin + SEGMENT + length - 1]
        h = gram_hashes(part)
        place = np.uint64((1 << 23) - 1)
        least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= reach:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span:])
        at = (least & place).astype(np.int64)
        start = np.arange(begin, begin + len(at))
        text = np.searchsorted(offsets, start, side="right") - 1 if len(offsets) < 3 else np.repeat(
            np.arange(len(offsets) - 1), np.diff(np.clip(offsets, begin, begin + len(at))))
        whole = start + length <= offsets[text + 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & whole)
        # A text's strings are one run of starts; a fragment ends before the next one's first, or with the run.
        ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        out.append((text[first], first + begin, ends + begin, h[at[first]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _buckets(owners: np.ndarray, count: int) -> np.ndarray:
    """Buckets of owners; these are least hashes, so they are mixed once more to fill all buckets alike."""
    return ((mixed(owners) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _short(owners: np.ndarray) -> np.ndarray:
    """The low half of an owner's hash: with the bucket it is told apart well enough for a first sieve."""
    return owners.astype(np.uint32)


def _owners(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Owners met in each slice, sent once each with their smallest document there.

    bucket, docs and counts (of the owners that follow for each document),
    owners, shared (by several documents of the slice).  bucket below 0: doc_id
    and the owners that a smaller document of its slice has too, dealt by doc_id.
    """

    def run(batches):
        for part in slices(batches, "text", SLICE):
            ids = column(part, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            text, _, _, owner = fragments(*concatenated(column(part, "text")), length)
            order = np.lexsort((ids[text], owner))
            owner, doc = owner[order], ids[text][order]
            pair = _runs(owner, doc)
            owner, doc = owner[pair], doc[pair]
            least = _runs(owner)
            shared = np.diff(np.append(np.flatnonzero(least), len(owner))) > 1
            first, holder = owner[least], doc[least]
            place = _buckets(first, buckets)
            order = np.lexsort((holder, place))  # by document inside a bucket: long runs, little to send
            first, holder, shared, place = first[order], holder[order], shared[order], place[order]
            rows, cuts = [], np.flatnonzero(_runs(place))
            for a, b in zip(cuts, np.append(cuts[1:], len(place))):
                heads = np.flatnonzero(_runs(holder[a:b]))
                counts = np.diff(np.append(heads, b - a)).astype(np.int32)
                rows.append((int(place[a]), None, holder[a:b][heads].tobytes(), counts.tobytes(), _short(first[a:b]).tobytes(), np.packbits(shared[a:b]).tobytes()))
            owner, doc = owner[~least], doc[~least]
            order = np.argsort(doc, kind="stable")
            owner, doc = _short(owner[order]), doc[order]
            cuts = np.flatnonzero(_runs(doc))
            rows += [(-1 - int(doc[a]) % buckets, int(doc[a]), b"", b"", owner[a:b].tobytes(), b"") for a, b in zip(cuts, np.append(cuts[1:], len(doc)))]
            columns = zip(*rows) if rows else ((),) * 6
            names = ["bucket", "doc_id", "docs", "counts", "owners", "shared"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(columns)], names)

    return docs.mapInArrow(run, "bucket long, doc_id long, docs binary, counts binary, owners binary, shared binary")


#: A row of findings: documents and hashes of their texts with the number of items that follow for each; then the items.
SENT = {"docs": np.int64, "marks": np.int64, "counts": np.int32}
SENT_ROW = "dest long, docs binary, marks binary, counts binary, items binary"


def _sent(doc: np.ndarray, mark: np.ndarray, items: np.ndarray, dests: int) -> pa.Table:
    """The items of each document and text, one row for each destination."""
    dest = doc % dests
    order = np.lexsort((mark, doc, dest))
    dest, doc, mark, items = dest[order], doc[order], mark[order], items[order]
    heads = np.flatnonzero(_runs(doc, mark))
    counts = np.diff(np.append(heads, len(doc)))
    cuts = np.append(np.flatnonzero(_runs(dest)), len(dest))
    of_heads = np.searchsorted(heads, cuts)
    values = [doc[heads], mark[heads], counts]
    columns = [[v[a:b].astype(t).tobytes() for a, b in zip(of_heads, of_heads[1:])] for v, t in zip(values, SENT.values())]
    columns.append([items[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
    return pa.table([pa.array(dest[cuts[:-1]], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["dest", *SENT, "items"])


def _gathered(table: pa.Table, kind: type) -> pa.Table:
    """(i, m, items) of one destination, one row for each document and text."""
    doc, mark, counts = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in SENT.items())
    items = np.frombuffer(b"".join(table["items"].to_pylist()), kind)
    doc, mark = np.repeat(doc, counts), np.repeat(mark, counts)
    order = np.lexsort((mark, doc))
    doc, mark, items = doc[order], mark[order], items[order]
    cuts = np.flatnonzero(_runs(doc, mark))
    parts = [items[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(doc)))]
    return pa.table([pa.array(doc[cuts], pa.int64()), pa.array(mark[cuts], pa.int64()), pa.array(parts, pa.binary())], names=["i", "m", "items"])


def _by_document(sent: DataFrame, kind: type) -> DataFrame:
    return sent.groupBy("dest").applyInArrow(lambda t: _gathered(t, kind), "i long, m long, items binary")


def _met(table: pa.Table, dests: int) -> pa.Table:
    """The owners that more than one document holds, sent to these documents."""
    if table["bucket"][0].as_py() < 0:
        owners = table["owners"].to_pylist()
        doc = np.repeat(table["doc_id"].to_numpy(), [len(o) // 4 for o in owners])
        return _sent(doc, np.zeros(len(doc), np.int64), np.frombuffer(b"".join(owners), np.uint32), dests)
    owner, heads, counts = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("owners", np.uint32), ("docs", np.int64), ("counts", np.int32)))
    doc = np.repeat(heads, counts)
    shared = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(o) // 4).astype(bool) for s, o in zip(table["shared"].to_pylist(), table["owners"].to_pylist())])
    order = np.lexsort((doc, owner))
    owner, doc, shared = owner[order], doc[order], shared[order]
    new = _runs(owner)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(first[1:], len(owner)) - 1
    keep = (doc[first] != doc[last])[group] | shared
    return _sent(doc[keep], np.zeros(int(keep.sum()), np.int64), owner[keep], dests)


#: A shuffled batch of fragments: documents and hashes of their texts with the number of fragments that follow for each; then the fragments.
PACKED = {"docs": np.int64, "marks": np.int64, "counts": np.int32, "owners": np.uint64, "starts": np.int32, "sizes": np.uint16, "bytes": np.uint8}


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), packed (the text's bytes, compressed for its way through the shuffles)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches, "text"):
            packed = [press(t.encode()) for t in column(part, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "mark"), pa.array(packed, pa.binary())], ["doc_id", "mark", "packed"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, packed binary")


def _texts(packed: pa.Array) -> list[bytes]:
    unpress = zstandard.ZstdDecompressor().decompress
    return [unpress(p) for p in packed.to_pylist()]


def _fragments(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Shared fragments of ``docs`` (doc_id, mark, packed, owners) by bucket; bucket below 0: what a smaller document of the slice has too, dealt by document."""

    def packed(pick, doc, mark, owner, start, size, body):
        heads = np.flatnonzero(_runs(doc[pick], mark[pick]))
        counts = np.diff(np.append(heads, len(pick)))
        values = (doc[pick][heads], mark[pick][heads], counts, owner[pick] if len(owner) else owner, start[pick], size[pick], body)
        out = [v.astype(t).tobytes() for v, t in zip(values, PACKED.values())]
        return [*out[:-1], zstandard.compress(out[-1], 3)]

    def run(batches):
        for part in slices(batches, "packed", SLICE // 4):
            ids, marks = (column(part, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            raw, offsets = concatenated(pa.array(_texts(column(part, "packed")), pa.binary()).cast(pa.string()))
            text, first, last, owner = fragments(raw, offsets, length)
            keep, edges = np.zeros(len(text), bool), np.searchsorted(text, np.arange(part.num_rows + 1))
            for k, known in enumerate(column(part, "owners").to_pylist()):
                if edges[k] < edges[k + 1]:
                    keep[edges[k]: edges[k + 1]] = np.isin(_short(owner[edges[k]: edges[k + 1]]), np.frombuffer(known, np.uint32))
            text, first, last, owner = (x[keep] for x in (text, first, last, owner))
            size = last - first + length
            digest = _digests(raw, first, size)
            order = np.lexsort((ids[text], digest, size, owner))
            text, first, size, owner, digest = (x[order] for x in (text, first, size, owner, digest))
            least = _runs(owner, size, digest)
            doc, mark, start = ids[text], marks[text], first - offsets[text]
            lost = ~least & (doc > doc[np.flatnonzero(least)][np.cumsum(least) - 1]) if len(doc) else least
            out = []
            at = np.flatnonzero(~lost)
            bucket = _buckets(owner[at], buckets)
            order = np.lexsort((mark[at], doc[at], bucket))
            at, bucket = at[order], bucket[order]
            cuts = np.flatnonzero(_runs(bucket))
            for a, b in zip(cuts, np.append(cuts[1:], len(at))):
                pick = at[a:b]
                n = size[pick]
                body = raw[np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                out.append([int(bucket[a]), *packed(pick, doc, mark, owner, start, size, body)])
            at = np.flatnonzero(lost)
            order = np.lexsort((mark[at], doc[at], doc[at] % buckets))
            at = at[order]
            cuts = np.flatnonzero(_runs(doc[at] % buckets))
            for a, b in zip(cuts, np.append(cuts[1:], len(at))):
                out.append([-1 - int(doc[at[a]] % buckets), *packed(at[a:b], doc, mark, owner[:0], start, size, raw[:0])])
            columns = zip(*out) if out else ((),) * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(columns)], ["bucket", *PACKED])

    return docs.mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in PACKED))


def _unpacked(table) -> list[np.ndarray]:
    """doc, mark, owner, start, size of each fragment of the rows, and all their bytes."""
    joined = {c: np.frombuffer(b"".join(_texts(table.column(c)) if c == "bytes" else table.column(c).to_pylist()), t) for c, t in PACKED.items()}
    counts = joined["counts"]
    return [np.repeat(joined["docs"], counts), np.repeat(joined["marks"], counts), joined["owners"], joined["starts"].astype(np.int64), joined["sizes"].astype(np.int64), joined["bytes"]]


def _ranges(doc: np.ndarray, mark: np.ndarray, first: np.ndarray, last: np.ndarray, dests: int) -> pa.Table:
    """Ranges of starts, as pairs of 32-bit integers, sent to their texts."""
    return _sent(doc, mark, np.stack([first, last], 1).astype(np.int32).view(np.uint64)[:, 0], dests)


def _digests(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit digest of the bytes of each fragment (in any order, within ``raw``)."""
    out = np.zeros(len(first), np.uint64)
    order = np.argsort(first, kind="stable")
    ends = np.maximum.accumulate((first + size)[order]) if len(order) else first
    up, down = _powers(1 << 20)
    at = 0
    while at < len(order):  # stretches short enough for the powers at hand
        base = int(first[order[at]])
        stop = at + int(np.searchsorted(ends[at:], base + len(up), side="right"))
        if stop == at:
            raise ValueError("a fragment longer than a stretch")
        pick = order[at:stop]
        total = np.append(np.uint64(0), np.cumsum(_LETTER[raw[base: int(ends[stop - 1])]] * up[: int(ends[stop - 1]) - base]))
        out[pick] = mixed((total[first[pick] + size[pick] - base] - total[first[pick] - base]) * down[first[pick] - base])
        at = stop
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, as far as ``depth`` letters.

    ``text``: letters from 1 on, with a 0 after every part; suffixes end there.
    Two stages: suffixes smaller than their successors are sorted directly, the
    rest fall into place as the buckets of first letters are scanned.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # a run of equal letters is of one kind
    rises = text[change] < text[change + 1]
    run = np.searchsorted(change, np.arange(n))
    small = np.append(rises, False)[run]
    stop = text == 0
    small[stop] = False
    direct = np.flatnonzero(small)
    left = np.flatnonzero(stop)[np.searchsorted(np.flatnonzero(stop), direct)] - direct  # letters up to the part's end
    padded = np.append(text, np.zeros(depth + 8, np.uint8))
    keys = []
    for k in range(0, depth, 8):
        word = np.zeros(len(direct), np.uint64)
        for b in range(8):
            letter = padded[direct + k + b].astype(np.uint64)
            letter[left <= k + b] = 0
            word = word << np.uint64(8) | letter
        keys.append(word)
    direct = direct[np.lexsort(keys[::-1])]
    bounds = np.searchsorted(text[direct], np.arange(257))
    larger = ~small & ~stop
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(wave: np.ndarray, own: int) -> np.ndarray:
        """Put the predecessors of a sorted wave at the ends of their buckets; those of the bucket itself come back."""
        before = wave[wave > 0] - 1
        before = before[larger[before]]
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(_runs(letters)) if len(letters) else np.zeros(0, np.int64)
        back = before[:0]
        for a, b in zip(cuts, np.append(cuts[1:], len(letters))):
            if letters[a] == own:
                back = before[a:b]
            else:
                waiting[letters[a]].append(before[a:b])
        return back

    out = [np.flatnonzero(stop)]
    induce(out[0], 0)
    for c in range(1, 256):
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        wave = direct[bounds[c]: bounds[c + 1]]
        if len(wave):
            out.append(wave)
            induce(wave, c)
    return np.concatenate(out)


def first_holders(text: np.ndarray, starts: np.ndarray, holders: np.ndarray, length: int) -> np.ndarray:
    """For each of the ``starts`` of ``text``, the least of the holders of an equal string of ``length`` letters."""
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = suffix_order(text, length)
    order = order[number[order] >= 0]
    same = np.zeros(len(order), bool)  # common prefix with the one before of ``length`` or more
    letters = np.arange(length)
    for k in range(1, len(order), 1 << 16):
        here = order[k: k + (1 << 16)]
        same[k: k + len(here)] = (text[here[:, None] + letters] == text[order[k - 1: k - 1 + len(here)][:, None] + letters]).all(1)
    out = np.empty(len(starts), holders.dtype)
    who = number[order]
    cuts = np.flatnonzero(~same)
    if len(cuts):
        out[who] = np.repeat(np.minimum.reduceat(holders[who], cuts), np.diff(np.append(cuts, len(order))))
    return out


def _within(many: np.ndarray, raw: np.ndarray, doc: np.ndarray, size: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, first, last): runs of starts inside the fragments ``many`` that a fragment of a smaller document among them holds too."""
    n = size[many]
    places = np.cumsum(n + 1) - (n + 1)
    text = np.zeros(int((n + 1).sum()), np.uint8)
    inner = np.arange(n.sum())
    text[np.repeat(places - (np.cumsum(n) - n), n) + inner] = raw[np.repeat(begin[many] - (np.cumsum(n) - n), n) + inner] + 1  # UTF-8 has no byte 255
    count = n - length + 1
    which = np.repeat(np.arange(len(many)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    gone = first_holders(text, places[which] + inner, doc[many][which], length) < doc[many][which]
    which, inner = which[gone], inner[gone]
    new = _runs(which)
    new[1:] |= inner[1:] != inner[:-1] + 1
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(which)) - 1 if len(a) else a
    return many[which[a]], inner[a], inner[b]


def _lost(table: pa.Table, length: int, dests: int) -> pa.Table:
    """The ranges of starts of strings that a smaller document holds, sent to the texts that lose them."""
    doc, mark, owner, start, size, raw = _unpacked(table)
    if table["bucket"][0].as_py() < 0:
        return _ranges(doc, mark, start, start + size - length, dests)
    begin = np.cumsum(size) - size
    digest = _digests(raw, begin, size)
    order = np.lexsort((doc, digest, size, owner))
    doc, mark, owner, start, size, begin, digest = (x[order] for x in (doc, mark, owner, start, size, begin, digest))
    new = _runs(owner, size, digest)
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = doc[head][group]
    whole = doc > least
    pick, firsts, lasts = [np.flatnonzero(whole)], [start[whole]], [(start + size - length)[whole]]

    # Owners with different fragments: one text of all of them, each once, a bounded part of the owners at a time.
    sole = np.bincount(np.cumsum(_runs(owner[head])) - 1)
    many = head[np.repeat(sole > 1, sole)]
    letters = np.cumsum(size[many] + 1)
    begins = np.flatnonzero(_runs(owner[many])) if len(many) else np.zeros(0, np.int64)
    mates = np.flatnonzero(~whole)
    at = 0
    while at < len(many):
        upto = np.searchsorted(letters, (letters[at - 1] if at else 0) + SORTED_BYTES)
        stop = begins[np.searchsorted(begins, max(upto, at + 1))] if max(upto, at + 1) <= begins[-1] else len(many)
        found = _within(many[at:stop], raw, doc, size, begin, length)
        which, first, last = found
        # Every row whose document is the fragment's smallest shares these runs (repeated rows of one id).
        low, high = (np.searchsorted(group[mates], group[which], side=x) for x in ("left", "right"))
        times = high - low
        run = np.repeat(np.arange(len(which)), times)
        mate = mates[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        pick.append(mate), firsts.append(start[mate] + first[run]), lasts.append(start[mate] + last[run])
        at = stop
    pick = np.concatenate(pick)
    return _ranges(doc[pick], mark[pick], np.concatenate(firsts), np.concatenate(lasts), dests)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, kept, n_removed, n_spans from (doc_id, mark, packed, lost)."""

    def run(batches):
        for part in slices(batches, "packed"):
            kept, gone, spans = [], [], []
            for raw, lost in zip(_texts(column(part, "packed")), column(part, "lost").to_pylist()):
                pairs = np.frombuffer(lost, np.int32).reshape(-1, 2)
                ranges = sorted(zip(pairs[:, 0].tolist(), (pairs[:, 1] + length).tolist()))
                out, end, count, total = [], 0, 0, 0
                for a, b in ranges:
                    if not count or a > end:
                        out.append(raw[end: a])
                        count, total, end = count + 1, total + b - a, b
                    elif b > end:
                        total, end = total + b - end, b
                kept.append(b"".join(out) + raw[end:])
                gone.append(total), spans.append(count)
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "mark"), pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())],
                ["doc_id", "mark", "kept", "n_removed", "n_spans"])

    return docs.select("doc_id", "mark", "packed", "lost").mapInArrow(run, "doc_id long, mark long, kept binary, n_removed long, n_spans long")


def repeats_cut(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, mark (hash of the text), kept, n_removed, n_spans of the documents that lose something."""
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    mine = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    size = mine.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(width(docs.sparkSession), size // GROUP_TEXT)
    dests = max(width(docs.sparkSession), size // SENT_TEXT)
    met = _owners(mine, length, buckets).groupBy("bucket").applyInArrow(lambda t: _met(t, dests), SENT_ROW)
    # Stored, so that the shuffles of the first sieve are gone before those of the fragments come.
    named = written(_by_document(met, np.uint32).select(F.col("i").alias("holder"), F.col("items").alias("owners")), "owners")
    texts = _packed(mine)
    held = texts.join(named.hint("merge"), F.col("doc_id") == F.col("holder")).select("doc_id", "mark", "packed", "owners")
    parts = _fragments(held, length, buckets)
    lost = parts.groupBy("bucket").applyInArrow(lambda t: _lost(t, length, dests), SENT_ROW)
    lost = written(_by_document(lost, np.uint64).withColumnRenamed("items", "lost"), "lost")
    removed(docs.sparkSession, named)
    # Shuffled at every size: the plan that large tables need.
    whole = texts.join(lost.hint("merge"), (F.col("doc_id") == F.col("i")) & (F.col("mark") == F.col("m")))
    return written(_cut(whole, length), "cut")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    cut = repeats_cut(docs, length).select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    none = F.lit(0).cast("bigint")
    return every.join(cut, (F.col("doc_id") == F.col("i")) & (F.col("mark") == F.col("m")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
