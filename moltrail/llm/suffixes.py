"""Operator 1, exact repeats of 50 bytes by suffix arrays.

Each byte goes that lies in a 50-byte string which also starts in a document of smaller id.

1. Documents are dealt to shards. In each, every 50-byte window is given an anchor: the start of the
   least hashed ANCHOR-byte string in it. Equal windows have equal anchors at equal places, so only
   windows whose anchor occurs in two documents can repeat. Shards send their distinct anchors, with
   the number of documents, to buckets, which answer a bit for each: whether it is shared.
2. A shard's windows of shared anchors make its candidate text. Its suffix array is built by
   Larsson-Sadakane refinement, common prefixes of neighbours by Kasai's rule; windows whose group has
   a smaller document in the shard are marked. Of the others each distinct window goes on once, whatever its
   places in the shard, in pieces of the windows of an anchor, to the anchor's bucket; its other places follow it in the end.
3. A bucket sorts the shards' pieces by anchor and hash, and neighbours of equal bytes are one piece; pieces
   with the same anchor that differ are compared by a new suffix array in blocks, blocks merged by binary
   search in their sorted windows. The shards' suffix arrays aren't merged with each other. Windows of an anchor that more than HOT
   documents, or places of one shard, hold are dealt by the window's own hash instead, so that no bucket gathers them.
4. Each shard applies its marks.

Shards and buckets exchange a row each way at most, and none for a bucket that a shard has no anchor or piece for, so
that rows are never more than anchors: linear in the input, however many shards there are.

Rows: null text is empty; texts of under 50 bytes lose nothing; documents of equal id don't count as
smaller than each other, and each row gives a row; a null doc_id comes after all others and is null in
the result; extra columns are ignored. A task holds a shard or a bucket, about SHARD_BYTES of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import mix, pack, shuffle_partitions, table, unpack
from .shards import NO_ID, as_table, opened, shard_count, sharded

LENGTH = 50
ANCHOR = 24
HOT = 1000
BLOCK = 4 << 20
CHUNK = 1 << 18
SHARD_BYTES = 8 << 20
_HASH_BITS = np.uint64(16)  # anchors are 48 bits
_CROWDED = np.uint32(1 << 31)  # beside a count of documents: there are many places


def words8(data: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n places the 8 bytes from it on, as one number; data has 8 more bytes."""
    return np.ndarray((n,), np.dtype("<u8"), data, 0, (1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    w = words8(data, n + 16)
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += w[16 : n + 16] * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h


def leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` values how far its leftmost least value is; windows twice as long each time."""
    least, at, reach = h, np.zeros(len(h), np.uint8), 1
    while reach < span:
        step = min(reach, span - reach)
        right = least[step:]
        take = right < least[:-step]
        far = at[step:] + np.uint8(step)
        at = at[:-step].copy()
        np.copyto(at, far, where=take)
        least = np.minimum(least[:-step], right)
        reach += step
    return at


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first and last window start, the anchor's hash, the document."""
    total = max(0, len(data) - LENGTH + 1)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    size = np.diff(ends)
    long = size >= LENGTH
    edge = np.zeros(len(data) + 1, np.int8)
    edge[ends[:-1][long]] = 1
    edge[ends[1:][long] - LENGTH + 1] = -1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)  # window starts
    begins = edge[:-1] == 1
    firsts, hashes = [], []
    span, before = LENGTH - ANCHOR + 1, -1
    for lo in range(0, total, CHUNK):
        n = min(CHUNK, total - lo)
        h = gram_hashes(padded[lo : lo + n + LENGTH + 24], n + span)
        at = leftmost_least((h >> np.uint64(32)).astype(np.uint32), span)[:n]
        place = at + np.arange(n, dtype=np.int32)
        new = np.ones(n, bool)
        new[1:] = place[1:] != place[:-1]
        new[0] = place[0] + lo != before
        before = int(place[-1]) + lo
        new |= begins[lo : lo + n]
        new &= inside[lo : lo + n]
        own = np.flatnonzero(new)
        firsts.append(own + lo)
        hashes.append(h[place[own]] >> _HASH_BITS)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate(firsts)
    doc = np.searchsorted(ends, first, side="right") - 1
    last = np.minimum(np.append(first[1:], total) - 1, ends[doc + 1] - LENGTH)
    return first, last, np.concatenate(hashes), doc


def distinct_anchors(h: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct anchors, the number of documents (by id) that each is in, and that of its places."""
    order = np.lexsort((doc, h))
    h, owner = h[order], ids[doc[order]]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return *np.unique(h[new], return_counts=True), np.unique(h, return_counts=True)[1]


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places in the order of their suffixes' first `depth` bytes, by Larsson-Sadakane refinement: suffixes are sorted
    by 8 bytes, then groups of equal ones by the group of the suffix h later, h doubling; groups of one are left alone."""
    n = len(text)
    keys = words8(np.concatenate([text, np.zeros(8, np.uint8)]), n)
    keys.byteswap(inplace=True)
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    same = np.zeros(n + 1, bool)
    np.equal(keys[1:], keys[:-1], out=same[1:n])
    del keys
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(same[:n], np.int32(0), np.arange(n, dtype=np.int32)))
    h = 8
    while h < depth:
        open_ = np.flatnonzero(same[:n] | same[1:]).astype(np.int32)  # slots of groups of two and more
        if not len(open_):
            break
        place = order[open_]
        key = rank[place].astype(np.uint64) << np.uint64(32)
        key |= (rank[np.minimum(place + np.int32(h), np.int32(n))] + 1).astype(np.uint64)
        by = np.argsort(key).astype(np.int32)
        place = place[by]
        key = key[by]
        del by
        order[open_] = place
        equal = np.zeros(len(open_), bool)
        np.equal(key[1:], key[:-1], out=equal[1:])
        del key
        same[open_] = equal
        rank[place] = np.maximum.accumulate(np.where(equal, np.int32(0), open_))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH, lanes: int = 4096) -> np.ndarray:
    """For each slot of the suffix array the common prefix with the slot before, up to `most`, by Kasai's rule: going
    through the text, the prefix is at least the one before less one, as long as the two suffixes, each one shorter, stand
    in the same order (suffixes sorted to a depth only may not). Lanes of the text go side by side."""
    n = len(text)
    slot = np.full(n + 2, n, np.int32)
    slot[order] = np.arange(n, dtype=np.int32)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[:1]] = n
    out = np.zeros(n + 1, np.uint8)
    length = -(-n // max(1, min(lanes, n // 64 + 1)))
    place = np.arange(0, n, length)
    stop = np.minimum(place + length, n)
    w = np.ndarray((n + most + 8,), np.dtype("<u8"), np.concatenate([text, np.zeros(most + 16, np.uint8)]), 0, (1,))
    h = np.zeros(len(place), np.int64)
    while len(place):  # eight bytes at a time
        other = before[place]
        x = w[place + h] ^ w[other + h]
        same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3
        most_here = np.minimum(n - np.maximum(place, other), most)
        grown = np.minimum(h + same, most_here)
        done = (same < 8) | (grown >= most_here)
        own = place[done]
        out[own] = grown[done]
        after = other[done] + 1
        ordered = slot[np.minimum(after, n)] < slot[own + 1]
        h = grown
        h[done] = np.where(ordered, np.maximum(grown[done] - 1, 0), 0)
        place = place + done
        left = place < stop
        if not left.all():
            place, stop, h = place[left], stop[left], h[left]
    return out[order]


def window_groups(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given window starts in the order of the suffix array, and each one's group of equal windows."""
    order = suffix_array(text)
    group = np.cumsum(common_prefixes(text, order) < LENGTH, dtype=np.int32)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    own = wanted[order]
    return order[own], group[own]


def least_of_groups(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member of sorted groups the least id of its group."""
    if not len(group):
        return ids
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    return np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(group))))


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., last of each run, one after another."""
    n = last - first + 1
    out = np.repeat(first - (np.cumsum(n) - n), n)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def runs_of(places: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers among sorted ones, also cut where `apart` changes: index of the first and last of each."""
    if not len(places):
        return places, places
    new = np.diff(places, prepend=places[0] - 2) != 1
    if apart is not None:
        new[1:] |= apart[1:] != apart[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(places)) - 1


def shared_text(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs of windows that touch, joined, and for each byte its place in data."""
    a, b = runs_of(spread(first, last)) if len(first) else (first, first)
    every = spread(first, last)
    at = spread(every[a], every[b] + LENGTH - 1) if len(a) else every
    return data[at], at


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of differences, which are mostly 0 where places follow each other."""
    return np.diff(np.diff(x, prepend=0), prepend=0)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % np.uint64(n)).astype(np.int64)


def _entries(n_buckets: int, hot: int):
    def run(key, rows):
        ids, data, ends = opened(rows)
        _, _, h, doc = anchor_runs(data, ends)
        h, count, places = distinct_anchors(h, doc, ids)
        count = np.minimum(count, _CROWDED - 1).astype(np.uint32) | np.where(places > hot, _CROWDED, np.uint32(0))
        bucket = _buckets(h, n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            own = order[a:b]
            steps = np.diff(h[own], prepend=np.uint64(0))
            out.append((int(bucket[own[0]]), key[0].as_py(), pack(steps.view(np.uint8).reshape(-1, 8).T), pack(count[own])))
        return as_table(out, ["bucket", "shard", "anchors", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _read_steps(blob: bytes) -> np.ndarray:
    raw = unpack(blob, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel())


def _answers(hot: int):
    def run(key, rows):
        shard = rows.column("shard").to_pylist()
        h = [_read_steps(x.as_py()) for x in rows.column("anchors")]
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in rows.column("counts")])
        every = np.concatenate(h)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=every[order[0]] + np.uint64(1)) != 0)
        total = np.add.reduceat((counts[order] & ~_CROWDED).astype(np.int64), first)
        crowded = (total > hot) | (np.maximum.reduceat(counts[order], first) >= _CROWDED)
        many = np.empty(len(every), np.uint8)
        many[order] = np.repeat((total > 1).astype(np.uint8) + ((total > 1) & crowded), np.diff(np.append(first, len(every))))
        out, at = [], 0
        for s, x in zip(shard, h):
            out.append((s, key[0].as_py(), pack(many[at : at + len(x)])))
            at += len(x)
        return as_table(out, ["shard", "bucket", "many"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def _send(out: list, bucket: np.ndarray, shard: int, anchor, first, last, owner, ids, data) -> None:
    """Pieces to buckets: runs of windows first..last in data, of documents `owner` (places) with `ids`."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        text = data[spread(first[own], last[own] + LENGTH - 1)]
        out.append((int(bucket[own[0]]), shard, 0, pack(anchor[own]), pack(first[own]), pack((last - first)[own].astype(np.uint32)), pack(ids[owner[own]]), pack(text)))


_PIECES = (["bucket", "shard", "kind", "anchor", "first", "more", "ids", "text"], [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5])


def _pieces(n_buckets: int):
    def run(key, rows, answers):
        shard, out = key[0].as_py(), []
        ids, data, ends = opened(rows)
        first, last, h, doc = anchor_runs(data, ends)
        known = np.unique(h)
        bucket, many = _buckets(known, n_buckets), np.zeros(len(known), np.uint8)
        order = np.argsort(bucket, kind="stable")
        for b, x in zip(answers.column("bucket").to_pylist(), answers.column("many")):
            lo, hi = np.searchsorted(bucket[order], [b, b + 1])
            many[order[lo:hi]] = unpack(x.as_py(), np.uint8)
        many = many[np.searchsorted(known, h)] if len(h) else many
        keep = many > 0
        first, last, h, doc, many = first[keep], last[keep], h[keep], doc[keep], many[keep]
        if not len(first):
            return as_table(out, *_PIECES)
        starts = spread(first, last)
        run_of = np.repeat(np.arange(len(first), dtype=np.int32), last - first + 1)
        gone, again = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        follow = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        here = np.flatnonzero(times[which] > 1)  # only an anchor that is here twice can have equal windows here
        if len(here):
            inner = np.flatnonzero((times[which] > 1)[run_of]).astype(np.int32)
            text, at = shared_text(data, first[here], last[here])
            place = np.searchsorted(at, starts[inner]).astype(np.int32)  # of each window start in that text
            del at
            window, group = window_groups(text, place)
            window = inner[np.searchsorted(place, window)]
            del inner, place, text
            owner = ids[doc[run_of[window]]]
            later = owner > least_of_groups(group, owner)
            gone[window[later]] = True
            # those left of a group belong to one document: the first place goes on, the others follow it
            del owner
            window, group = window[~later], group[~later]
            head = least_of_groups(group, window)
            other = head != window
            del group, later
            window, head = window[other], head[other]
            again[window] = True
            by = np.argsort(window)
            follow = [starts[window[by]], starts[head[by]]]
            del window, head, by
        if len(follow[0]):
            out.append((shard % n_buckets, shard, 2, b"", pack(_steps(follow[0])), pack(_steps(follow[0] - follow[1])), b"", b""))
        a, b = runs_of(starts[gone])
        if len(a):
            marked = starts[gone]
            out.append((shard % n_buckets, shard, 1, b"", pack(marked[a]), pack((marked[b] - marked[a]).astype(np.uint32)), b"", b""))
        left = np.flatnonzero(~gone & ~again)
        hot = many[run_of[left]] > 1
        cool, single = left[~hot], left[hot]
        a, b = runs_of(starts[cool], run_of[cool])
        name = [h[run_of[cool[a]]]] if len(cool) else []
        if len(single):  # by the window itself
            f, w = starts[single], words8(np.concatenate([data, np.zeros(8, np.uint8)]), len(data))
            own = np.zeros(len(f), np.uint64)
            for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
                own = mix(own * np.uint64(31) + w[f + k])
            name.append(own)
        if name:
            name = np.concatenate(name)
            f, l = np.concatenate([starts[cool[a]], starts[single]]), np.concatenate([starts[cool[b]], starts[single]])
            r = np.concatenate([run_of[cool[a]], run_of[single]])
            _send(out, _buckets(name, n_buckets), shard, name, f, l, doc[r], ids, data)
        return as_table(out, *_PIECES)

    return run


def _merge_blocks(text: np.ndarray, begin: np.ndarray, n: np.ndarray, ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces (begin in text, n windows, document id): window starts in the text, and whether a smaller document has the window."""
    sizes = n + LENGTH - 1
    cut = np.searchsorted(np.cumsum(sizes), np.arange(block, int(sizes.sum()) + block, block)) + 1
    keys = least = None
    parts = []
    a = 0
    for b in np.unique(np.minimum(cut, len(begin))):
        own = np.arange(a, b)
        if not len(own):
            continue
        a = b
        lo, hi = int(begin[own[0]]), int(begin[own[-1]] + sizes[own[-1]])
        starts = spread(begin[own], begin[own] + n[own] - 1)
        owner = np.repeat(ids[own], n[own])
        sorted_, group = window_groups(text[lo:hi], starts - lo)
        starts = sorted_ + lo
        owner = owner[np.searchsorted(spread(begin[own], begin[own] + n[own] - 1), starts)]
        parts.append((starts, owner))
        new = np.diff(group, prepend=group[0] - 1) != 0
        best = np.minimum.reduceat(owner, np.flatnonzero(new))
        heads = text[starts[new][:, None] + np.arange(LENGTH)].copy().view(f"S{LENGTH}").ravel()  # sorted, each once
        if keys is None:
            keys, least = heads, best
        else:  # binary search of the one's sorted windows in the other's
            k = np.searchsorted(keys, heads)
            same = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == heads)
            least[k[same]] = np.minimum(least[k[same]], best[same])
            keys, least = np.insert(keys, k[~same], heads[~same]), np.insert(least, k[~same], best[~same])
    if keys is None:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    starts, owner = (np.concatenate(x) for x in zip(*parts))
    flags = np.empty(len(starts), bool)
    for k in range(0, len(starts), block):
        s = starts[k : k + block]
        at = np.searchsorted(keys, text[s[:, None] + np.arange(LENGTH)].copy().view(f"S{LENGTH}").ravel())
        flags[k : k + block] = owner[k : k + block] > least[at]
    return starts, flags


_MARKS = (["shard", "kind", "first", "more"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def _merge(block: int):
    def run(key, rows):
        out = []
        for kind, s, f, m in zip(*(rows.column(c).to_pylist() for c in ("kind", "shard", "first", "more"))):
            if kind:
                out.append((s, kind, f, m))
        rows = rows.filter(pc.equal(rows.column("kind"), 0))
        if not rows.num_rows:
            return as_table(out, *_MARKS)
        read = lambda c, t: [unpack(x.as_py(), t) for x in rows.column(c)]
        anchor, first, more, ids = read("anchor", np.uint64), read("first", np.int64), read("more", np.uint32), read("ids", np.int64)
        shard = np.repeat(np.array(rows.column("shard").to_pylist()), [len(x) for x in first])
        anchor, first, more, ids = (np.concatenate(x) for x in (anchor, first, more, ids))
        text = np.concatenate([unpack(x.as_py(), np.uint8) for x in rows.column("text")])
        n = more.astype(np.int64) + 1
        size = n + LENGTH - 1
        begin = np.cumsum(size) - size
        whole = np.zeros(len(begin), np.uint64)  # a hash of the whole piece, by its words of 8 bytes
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        w = words8(padded, len(text))
        for k in range(0, int(size.max()), 8):
            live = np.flatnonzero(size >= 8 + k)
            whole[live] = mix(whole[live] * np.uint64(31) + w[begin[live] + k])
        whole = mix(whole * np.uint64(31) + w[begin + size - 8] + size.astype(np.uint64))
        order = np.lexsort((ids, whole, anchor))
        sorted_keys = np.stack([anchor[order], whole[order]])
        new = np.ones(len(order), bool)
        new[1:] = (sorted_keys[:, 1:] != sorted_keys[:, :-1]).any(axis=0)
        heads = order[new]  # the least document of each distinct piece
        head = np.empty(len(order), np.int64)
        head[order] = np.repeat(heads, np.diff(np.append(np.flatnonzero(new), len(order))))
        same_text = size == size[head]
        for k in [*range(0, int(size.max()) - 7, 8), -8]:  # equal hashes: the bytes too
            p, q = (begin + k, begin[head] + k) if k >= 0 else (begin + size - 8, begin[head] + size[head] - 8)
            ok = (size >= k + 8) & same_text
            same_text[ok] &= w[p[ok]] == w[q[ok]]
        head = np.where(same_text, head, np.arange(len(head)))
        # distinct pieces of anchors with more than one: suffix arrays
        distinct = np.unique(head)
        by = distinct[np.argsort(anchor[distinct], kind="stable")]
        _, where, count = np.unique(anchor[by], return_inverse=True, return_counts=True)
        some = by[count[where] > 1]
        gone = np.zeros(len(text), bool)  # by window start
        if len(some):
            at = spread(begin[some], begin[some] + size[some] - 1)
            sub_begin = np.cumsum(size[some]) - size[some]
            starts, flags = _merge_blocks(text[at], sub_begin, n[some], ids[some], block)
            gone[at[starts[flags]]] = True
        # each piece: all its windows if its head is of a smaller document, else those of its head
        every = spread(begin, begin + n - 1)
        piece = np.repeat(np.arange(len(begin)), n)
        inner = every - begin[piece]
        flags = (ids[piece] > ids[head[piece]]) | gone[begin[head[piece]] + inner]
        place, piece = (first[piece] + inner)[flags], piece[flags]
        by = np.lexsort((place, shard[piece]))
        place, owner = place[by], shard[piece[by]]
        a, b = runs_of(place, owner)
        for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(owner[a])) + 1) if len(a) else []:
            out.append((int(owner[a[own[0]]]), 1, pack(place[a[own]]), pack((place[b[own]] - place[a[own]]).astype(np.uint32))))
        return as_table(out, *_MARKS)

    return run


def _apply(key, rows, marks):
    ids, data, ends = opened(rows)
    edge = np.zeros(len(data) + 1, np.int32)
    follow = []
    for kind, f, m in zip(marks.column("kind").to_pylist(), marks.column("first"), marks.column("more")):
        if kind == 1:
            first, more = unpack(f.as_py(), np.int64), unpack(m.as_py(), np.uint32).astype(np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + more + 1, -1)
        else:
            place, back = (np.cumsum(np.cumsum(unpack(x.as_py(), np.int64))) for x in (f, m))
            follow.append((place, place - back))
    starts = np.cumsum(edge[:-1], dtype=np.int32) > 0  # windows that go
    for place, head in follow:
        starts[place] |= starts[head]
    del edge, follow
    count = np.cumsum(starts, dtype=np.int32)
    gone = count > 0  # a byte goes if one of the LENGTH windows that hold it does
    gone[LENGTH:] = count[LENGTH:] > count[:-LENGTH]
    del starts, count
    total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    if len(gone):
        inner = ends[:-1][ends[:-1] < len(gone)]
        head[inner] = gone[inner]
    heads = np.concatenate([np.zeros(1, np.int32), np.cumsum(head, dtype=np.int32)])
    digest = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
    per = lambda t: pa.array(t[ends[1:]] - t[ends[:-1]], pa.int64())
    return pa.table([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.diff(ends), pa.int64()), per(total), per(heads), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats_removed(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    n = shard_count(docs, SHARD_BYTES, shuffle_partitions(docs.sparkSession))
    shards = sharded(docs, n)
    by_shard = lambda: shards.groupBy("shard")
    entries = by_shard().applyInArrow(_entries(n, hot), "bucket int, shard int, anchors binary, counts binary")
    answers = entries.groupBy("bucket").applyInArrow(_answers(hot), "shard int, bucket int, many binary")
    pieces = by_shard().cogroup(answers.groupBy("shard")).applyInArrow(_pieces(n), "bucket int, shard int, kind int, anchor binary, first binary, more binary, ids binary, text binary")
    marks = pieces.groupBy("bucket").applyInArrow(_merge(block), "shard int, kind int, first binary, more binary")
    return by_shard().cogroup(marks.groupBy("shard")).applyInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
