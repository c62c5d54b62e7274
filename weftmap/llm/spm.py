"""SentencePiece encoding and decoding by suffix-array matching.

For BPE models with byte fallback and without normalisation (others are refused).
Text is cut where no piece reaches over (around a run of spaces, but its last, which
stays with what follows; around line breaks), and the different cuts that a worker
hasn't met are encoded together: their characters are indexed by a suffix array as
deep as the longest piece, each piece's occurrences are a range found by binary
search, and the occurrences are edges, sorted by position and relaxed from left to
right: an edge extends the encoding that ends at its start if BPE, given both
pieces' characters, would leave just these two. Encodings of prefixes nest in that
way, so at each place one edge at most holds, and the last places give the ids. A
cut of more than ``LONG`` characters is indexed and relaxed in blocks.

Pieces of spaces alone share one rank, below all others, so a run of spaces settles
after all else and by its length alone: the leftmost two that make a piece join,
again and again. Runs are settled that way, not through the suffix array; a run takes
in the space that the next cut begins with where that cut leaves it alone.

Decoding joins the pieces' bytes; ``encode`` followed by ``decode`` returns the
text, but that U+2581 comes back as a space.

Defined results: null and empty texts have no ids; repeated rows are encoded
alike; a text of any length, of any one letter or of spaces, is handled whole and in
time in proportion to it; a kept column named like one that is made comes back with
``_in`` at the end of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import wordhash as H
from .common import batches, carry, columns, crc, text_bytes
from .hashindex import HashIndex, Rows, take

BAR = "▁"
#: Different cuts, and judged pairs, that a worker keeps; beyond it starts anew.
KEPT = 1 << 19
#: Bytes of unmet cuts that are indexed together, about.
INDEXED = 1 << 18
#: Characters of a cut beyond which it is taken block by block, and of a block.
LONG, LONG_BLOCK = 1 << 10, 1 << 16
_CHARS_A_KEY = 4
_NONE, _FIRST, _BYTES = -1, -2, -3


def merge_slowly(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, tuple[str, str] | None]]:
    """BPE by its definition: the best-ranked adjacent pair, the leftmost of equals, again and again. Each symbol comes with the two it was made of."""
    now = [(s, None) for s in symbols]
    while len(now) > 1:
        best = min(((rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(now, now[1:], strict=False)) if a[0] + b[0] in rank), default=None)
        if best is None:
            break
        i = best[1]
        now[i : i + 2] = [(now[i][0] + now[i + 1][0], (now[i][0], now[i + 1][0]))]
    return now


class Model:
    """The pieces of a model, and which two pieces may follow each other."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.path = path
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and identity normalisation")
        self.prefix = norm.add_dummy_prefix
        self.size = len(proto.pieces)
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        if any(BAR in p[1:] and p.strip(BAR) for _, p, _ in normal):
            raise ValueError("a piece reaches over the start of a word")
        order = sorted(normal, key=lambda x: -x[2])
        # equal scores get equal ranks: the leftmost pair goes first
        self.rank: dict[str, int] = {}
        last, r = None, -1
        for _, p, score in order:
            r += score != last
            last = score
            self.rank[p] = r
        self.id = {p: i for i, p, _ in normal}
        self.byte = np.zeros(256, np.int64)
        out = [b""] * self.size
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte[value] = i
                out[i] = bytes([value])
            elif p.type in (1, 4):
                out[i] = p.piece.replace(BAR, " ").encode()
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte] = True
        self.out_start = np.concatenate([[0], np.cumsum([len(b) for b in out])])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.chars = sorted({c for _, p, _ in normal for c in p})
        if any(c not in self.id for c in self.chars):
            raise ValueError("a piece has a character that is no piece")
        # what each piece is made of when it stands alone; pieces that BPE doesn't reach are never matched.
        # Longer pieces build on shorter ones, so all are settled in order of length by their last merge.
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.when = np.full(self.size, -1, np.int64)
        reach, spaces = [], {len(p) for _, p, _ in normal if len(p) > 1 and not p.strip(BAR)}
        if spaces and (len(own := {self.rank[BAR * k] for k in spaces}) > 1 or max(own) <= max((self.rank[p] for _, p, _ in normal if len(p) > 1 and p.strip(BAR)), default=-1)):
            raise ValueError("pieces of spaces don't rank below all others")
        self.space_lengths = spaces
        for i, p, _ in sorted(normal, key=lambda x: len(x[1])):
            if len(p) > 1:
                if not p.strip(BAR):
                    continue  # see ``spaces``
                made = merge_slowly(list(p), self.rank)
                if len(made) > 1:
                    continue
                a, b = made[0][1]
                self.left[i], self.right[i] = self.id[a], self.id[b]
                self.when[i] = self.rank[p]
            reach.append((p, i))
        pair, r = [], []
        for _, p, _ in normal:
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pair.append(a << 20 | b)
                    r.append(self.rank[p])
        order = np.argsort(np.array(pair, np.int64))
        self.pair = np.array(pair, np.int64)[order]
        self.pair_rank = np.array(r, np.int64)[order]
        # characters as small numbers, 0 for the end of a unit; pieces as keys of four characters each
        self.code = np.array([ord(c) for c in self.chars], np.uint32)
        self.unknown = len(self.chars) + 1
        self.bits = max(1, int(self.unknown + 1).bit_length())
        if self.bits > 16:
            raise ValueError("too many characters")
        self.longest = max(len(p) for p, _ in reach)
        keys = -(-self.longest // _CHARS_A_KEY)
        at = {c: k + 1 for k, c in enumerate(self.chars)}
        low, high = np.zeros((len(reach), keys * _CHARS_A_KEY), np.uint16), np.full((len(reach), keys * _CHARS_A_KEY), 0xFFFF, np.uint16)
        for j, (p, _) in enumerate(reach):
            low[j, : len(p)] = high[j, : len(p)] = [at[c] for c in p]
        as_text = lambda x: np.ascontiguousarray(x.astype(">u2")).view(f"S{2 * x.shape[1]}").ravel()
        self.low, self.high = as_text(low), as_text(high)
        self.keys = keys
        self.piece_id = np.array([i for _, i in reach], np.int64)
        self.piece_len = np.array([len(p) for p, _ in reach], np.int64)
        self.length = np.ones(self.size, np.int64)
        self.length[self.piece_id] = self.piece_len
        self.known = HashIndex(16)  # pairs that were judged
        self.known_pairs: dict[int, bool] = {}
        self.steps: tuple[list, list, list, dict] | None = None
        self.clear()

    def clear(self) -> None:
        """Forgets the cuts met so far."""
        self.index, self.rows = HashIndex(18), Rows(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.space_row: dict[int, int] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[k] == key, self.pair_rank[k], np.int64(1) << 40)

    def judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two pieces apart.

        Backwards in time: the last merge on either side of the border is undone,
        until both are characters. While two symbols faced each other, they
        would have merged if their pair came before the merge that ended it;
        of equal ranks the left one is first.
        """
        ok = np.ones(len(a), bool)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.int64(1) << 39)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            bad = 2 * self.pair_ranks(x, y) < limit[todo]
            ok[todo[bad]] = False
            wx = np.where(self.left[x] >= 0, 2 * self.when[x], -1)
            wy = np.where(self.left[y] >= 0, 2 * self.when[y] + 1, -1)
            go = ~bad & (np.maximum(wx, wy) >= 0)
            todo, x, y, wx, wy = todo[go], x[go], y[go], wx[go], wy[go]
            limit[todo] = np.maximum(wx, wy)
            a[todo] = np.where(wx > wy, self.right[x], x)
            b[todo] = np.where(wx > wy, y, self.left[y])
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = H.mix((a << 20 | b).astype(np.uint64) + np.uint64(1))
        got = self.known.find(key)
        if (got < 0).any():
            if len(self.known) > KEPT:
                self.known = HashIndex(16)
                got[:] = -1
            new, first = np.unique(key[got < 0], return_index=True)
            first = np.flatnonzero(got < 0)[first]
            self.known.add(new, self.judge(a[first], b[first]).astype(np.int32))
            got = self.known.find(key)
        return got > 0

    def suffixes(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, as deep as the longest piece, and its keys in order. ``left``: characters to the unit's end."""
        n, wide = len(code), self.keys * _CHARS_A_KEY
        padded = np.zeros(n + wide, np.uint16)
        padded[:n] = code
        grid = np.empty((n, wide), ">u2")
        for k in range(wide):
            grid[:, k] = np.where(left > k, padded[k : k + n], 0)
        keys = grid.view(">u8").astype(np.uint64)
        order = np.lexsort([keys[:, k] for k in range(self.keys - 1, -1, -1)])
        return order, grid[order].view(f"S{2 * wide}").ravel()

    def codes(self, cp: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.code, cp), len(self.code) - 1)
        return np.where(self.code[k] == cp, k + 1, self.unknown).astype(np.uint16)

    def edges(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the piece) of all occurrences of pieces."""
        order, keys = self.suffixes(code, left)
        lo, hi = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high, "right")
        count = hi - lo
        return order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())], np.repeat(np.arange(len(lo)), count)

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after another, and how many each has."""
        texts = [u.decode().replace(" ", BAR) for u in units]
        size = np.array([len(t) for t in texts], np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n = len(cp)
        end = np.cumsum(size)
        first = end - size
        place = np.arange(n) - np.repeat(first, size)
        left = np.repeat(size, size) - place
        code = self.codes(cp)
        start, piece = self.edges(code, left)
        stranger = np.flatnonzero(code == self.unknown)
        edge_start = np.concatenate([start, stranger])
        edge_id = np.concatenate([self.piece_id[piece], np.full(len(stranger), _BYTES)])
        edge_end = edge_start + np.concatenate([self.piece_len[piece], np.ones(len(stranger), np.int64)])
        depth = place[edge_start]
        by = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        edge_start, edge_id, edge_end = edge_start[by], edge_id[by], edge_end[by]
        cuts = np.searchsorted(depth[by], np.arange((int(depth.max()) if len(depth) else -1) + 2))
        last = np.full(n + 1, _NONE, np.int64)  # the piece that ends before each place
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, t, e = edge_start[a:b], edge_id[a:b], edge_end[a:b]
            own = np.where(place[s] == 0, _FIRST, last[s])
            go = own != _NONE
            s, t, e, own = s[go], t[go], e[go], own[go]
            test = np.flatnonzero((own >= 0) & (t >= 0))
            good = np.ones(len(s), bool)
            good[test] = self.compatible(own[test], t[test])
            last[e[good]] = t[good]
        # back from the units' ends
        chosen = np.zeros(n + 1, bool)
        at, begin = end, first
        while len(at):
            chosen[at] = True
            piece = last[at]
            at = at - np.where(piece >= 0, self.length[np.maximum(piece, 0)], 1)
            more = at > begin
            at, begin = at[more], begin[more]
        ends = np.flatnonzero(chosen)
        ids = last[ends]
        unit = np.searchsorted(end, ends)
        if not (ids == _BYTES).any():
            return ids, np.bincount(unit, minlength=len(units))
        out: list[list[int]] = [[] for _ in units]
        for u, i, e in zip(unit.tolist(), ids.tolist(), ends.tolist(), strict=True):
            out[u] += [i] if i >= 0 else self.byte[list(chr(cp[e - 1]).encode())].tolist()
        return np.array([i for x in out for i in x], np.int64), np.array([len(x) for x in out], np.int64)

    def apart(self, a: int, b: int) -> bool:
        """``judge`` for one pair, without arrays."""
        key = a << 20 | b
        got = self.known_pairs.get(key)
        if got is not None:
            return got
        if self.steps is None:
            self.steps = self.left.tolist(), self.right.tolist(), self.when.tolist(), dict(zip(self.pair.tolist(), self.pair_rank.tolist(), strict=True))
        if len(self.known_pairs) > KEPT:
            self.known_pairs.clear()
        left, right, when, rank = self.steps
        limit = 1 << 39
        while (r := rank.get(a << 20 | b)) is None or 2 * r >= limit:
            x, y = 2 * when[a] if left[a] >= 0 else -1, 2 * when[b] + 1 if left[b] >= 0 else -1
            if x < 0 and y < 0:
                self.known_pairs[key] = True
                return True
            limit = max(x, y)
            a, b = (right[a], b) if x > y else (a, left[b])
        self.known_pairs[key] = False
        return False

    def encode_long(self, unit: bytes, block: int = LONG_BLOCK) -> np.ndarray:
        """Ids of one long unit: its edges are found and relaxed block by block."""
        cp = np.frombuffer(unit.decode().replace(" ", BAR).encode("utf-32-le"), np.uint32)
        n = len(cp)
        code = self.codes(cp)
        last = np.full(n + 1, _NONE, np.int32)
        for a in range(0, n, block):
            part = code[a : a + block + self.longest]
            start, piece = self.edges(part, len(part) - np.arange(len(part)))
            own = start < min(block, n - a)
            start, piece = start[own], piece[own]
            strange = np.flatnonzero(part[:block] == self.unknown)
            start = np.concatenate([start, strange])
            ids = np.concatenate([self.piece_id[piece], np.full(len(strange), _BYTES)])
            size = np.concatenate([self.piece_len[piece], np.ones(len(strange), np.int64)])
            by = np.argsort(start, kind="stable")
            near = last[a : a + block + self.longest + 1].tolist()
            if not a:
                near[0] = _FIRST
            for s, t, k in zip(start[by].tolist(), ids[by].tolist(), size[by].tolist(), strict=True):
                before = near[s]
                if before != _NONE and (before < 0 or t < 0 or self.apart(before, t)):
                    near[s + k] = t
            last[a : a + len(near)] = near
        out, at = [], n
        while at > 0:
            i = int(last[at])
            out.append([i] if i >= 0 else self.byte[list(chr(cp[at - 1]).encode())].tolist())
            at -= int(self.length[i]) if i >= 0 else 1
        return np.array([i for x in reversed(out) for i in x], np.int64)

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of n spaces: of equally ranked pairs the leftmost joins, so what lies to the left is settled first."""
        made: list[int] = []
        while n:
            if made and made[-1] + 1 in self.space_lengths:
                made[-1] += 1
                n -= 1
            elif n > 1 and 2 in self.space_lengths:
                made.append(2)
                n -= 2
            else:
                made.append(1)
                n -= 1
            while len(made) > 1 and made[-2] + made[-1] in self.space_lengths:
                made[-2:] = [made[-2] + made[-1]]
        return [self.id[BAR * k] for k in made]

    def space_rows(self, lengths: np.ndarray) -> np.ndarray:
        own, back = np.unique(lengths, return_inverse=True)
        for k in own.tolist():
            if k not in self.space_row:
                ids = self.spaces(k)
                self.space_row[k] = self.rows.n
                self.rows.append(np.array([len(ids)], np.int64), np.array(ids, np.int64))
        return np.array([self.space_row[k] for k in own.tolist()], np.int64)[back]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (with their leading space, if the model adds one) and how many each has."""
        if not len(raw):
            return np.empty(0, self.rows.data.dtype), np.zeros(len(at) - 1, np.int64)
        start, run = units_of(raw, at)
        end = np.append(start[1:], len(raw))
        if len(self.index) > KEPT:
            self.clear()
        row = np.zeros(len(start), np.int64)
        word = np.flatnonzero(~run)
        h = H.mix(H._ranges(H._TABLE[raw], H._BASE, start[word], end[word]))
        row[word] = self.index.find(h)
        unmet = np.flatnonzero(row[word] < 0)
        if len(unmet):
            new, one = np.unique(h[unmet], return_index=True)
            one = word[unmet[one]]
            data = raw.tobytes()
            size = end[one] - start[one]
            long = size > LONG
            new, one, size = np.concatenate([new[~long], new[long]]), np.concatenate([one[~long], one[long]]), np.concatenate([size[~long], size[long]])
            self.index.add(new, np.arange(self.rows.n, self.rows.n + len(new), dtype=np.int32))
            unit = lambda i: data[start[i] : end[i]]
            short = one[size <= LONG]
            part = np.cumsum(size[: len(short)]) // INDEXED
            for some in np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else ():
                ids, n = self.encode_units([unit(i) for i in some.tolist()])
                self.rows.append(n, ids)
            for i in one[size > LONG].tolist():
                ids = self.encode_long(unit(i))
                self.rows.append(np.array([len(ids)], np.int64), ids)
            row[word] = self.index.find(h)
        # a run of spaces takes in the next cut's space where that stands alone
        drop = np.zeros(len(start), np.int64)
        runs = np.flatnonzero(run)
        if len(runs):
            alone = self.rows.data[self.rows.start[row[runs + 1]]] == self.id[BAR]
            drop[runs + 1] = alone
            row[runs] = self.space_rows(end[runs] - start[runs] + alone)
        first = self.rows.start[row] + drop
        n = self.rows.start[row + 1] - first
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.rows.data[np.repeat(first - done[:-1], n) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(start, at)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, one after another, and how many each has."""
        data, n = take(self.out_start, self.out, np.asarray(ids, np.int64))
        return data, n

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Texts as they are encoded: with the leading space, and U+2581 as a space."""
        if len(texts) and b"\xe2\x96\x81" in memoryview(text_bytes(texts)[0]).tobytes():
            texts = pc.replace_substring(texts, BAR, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
        return texts

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        ids, n = self.encode(*text_bytes(self.prepared(pa.array(texts, pa.string()))))
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []

    def decode_ids(self, ids: list[int]) -> str:
        text = self.decode(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def units_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and which are all of a run of spaces but its last: units begin at a text's start, at a run of spaces, at the last of several, before and after a line break."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[at] = True
    space = raw == 0x20
    after = np.zeros(n, bool)  # the next place has a space of the same run
    after[:-1] = space[1:] & ~first[1:-1]
    after &= space
    before = np.zeros(n, bool)
    before[1:] = after[:-1]
    line = raw == 0x0A
    cut = first[:-1] | space & ~(before & after)
    cut |= line
    cut[1:] |= line[:-1]
    starts = np.flatnonzero(cut)
    return starts, after[starts]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


_MADE = "n_tokens long, n_byte_tokens long, ids_crc32 long, decoded boolean"


def encode_partition(path: str, keep: list[str], text: str, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows, texts in batches(it, text):
            given = m.prepared(texts)
            if isinstance(given, pa.ChunkedArray):
                given = given.combine_chunks()
            raw, at = text_bytes(given)
            ids, n = m.encode(raw, at)
            ends = np.cumsum(n)
            data, size = m.decode(ids)
            done = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
            back = np.array_equal(done, at) and np.array_equal(data, raw)
            whole = np.ones(len(n), bool) if back else np.array([np.array_equal(data[done[i] : done[i + 1]], raw[at[i] : at[i + 1]]) for i in range(len(n))], bool)
            wide = ids.astype("<u4")
            cuts = [0, *ends.tolist()]
            bytes_of = np.add.reduceat(np.append(m.is_byte[ids], False).astype(np.int64), np.minimum(cuts[:-1], len(ids))) if len(n) else np.zeros(0, np.int64)
            bytes_of[n == 0] = 0
            made = {
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_byte_tokens": pa.array(bytes_of),
                "ids_crc32": pa.array([crc(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                "decoded": pa.array(whole),
            }
            if with_ids:
                made["ids"] = pa.array([ids[a:b].astype("<u2" if m.size <= 1 << 16 else "<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns(rows, keep), *made.values()], [*keep, *made])

    return run


def encode(docs: DataFrame, path: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """``keep`` columns with n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded (whether the ids give the text back) and, if asked, ids (as little-endian 16-bit numbers; 32-bit for models of over 65536 pieces). No shuffle."""
    own, names, (text,), schema = carry(docs, keep, _MADE + (", ids binary" if with_ids else ""))
    return own.mapInArrow(encode_partition(path, names, text, with_ids), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with its column ids) with the column text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        kind = "<u2" if m.size <= 1 << 16 else "<u4"
        for batch in it:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [m.decode_ids(np.frombuffer(x.as_buffer(), kind)) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded_text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*kinds, "decoded_text string"])).withColumnRenamed("decoded_text", "text" if "text" not in encoded.columns else "decoded_text")
