"""BPE encoding by per-prefix dynamic programming.

Every prefix of a word has one byte-pair encoding, hence one last token. For each prefix, an automaton over the
vocabulary gives the tokens that are a suffix of it, longest first; the one that is compatible with the last token of
what remains in front is the prefix's last token. Two tokens are compatible if merging their joined symbols gives just
these two, which is read off the order of their own merges. Back-pointers (a token's length) then spell the ids, exactly those of the merge procedure, in time linear in
the word. Words are solved thousands at a time, one prefix length after another, each a few array operations.

The automaton is made once, on the driver, and goes to the workers as arrays (``Tables``). Words repeat, so each Python
worker keeps what it has encoded lately; the stores are cleared when they are full.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import ship
from gridweave.llm._text import LET_GO, chunks

#: Entries and characters of a worker's store of words; clearing it costs time only.
STORE, STORE_CHARS = 130_000, 4_000_000
#: Cells (words times prefixes) that are solved together, and bytes from which a word is solved by itself.
CELLS, LONG = 500_000, 1_000
#: Ids of a text that are written out at a time.
WRITTEN = 1_000_000
#: White space of the Unicode property, which differs from ``str.isspace`` at the four separators 1C to 1F.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSPACED = re.compile(f"[^{_SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: What this encoder does before and after merging, as tokenizer files write it; a file that says otherwise is refused.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


class Vocabulary:
    """What a tokenizer file says: token ids, merge ranks, the split pattern, special tokens and the word-end mark.

    ``load`` refuses files that ask for another normal form, split, decoder or kind of model than this encoder has.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0])


    @staticmethod
    def check(spec: dict) -> None:
        def same(part: str, have, want) -> None:
            if have != want:
                raise ValueError(f"the tokenizer file's {part} is {have}, which is not what this encoder does: {want}")

        several = lambda x, key: x[key] if x and x.get("type") == "Sequence" else [x] if x else []
        same("normalizer", several(spec.get("normalizer"), "normalizers"), NORMALIZERS)
        parts = several(spec.get("pre_tokenizer"), "pretokenizers")
        same("pre_tokenizer", [{k: p.get(k) for k in want} for p, want in zip(parts, (SPLIT, BYTES), strict=False)], [SPLIT, BYTES])
        same("decoder", spec.get("decoder"), None)
        off = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        same("model", (spec["model"]["type"], [k for k in off if spec["model"].get(k)]), ("BPE", []))
        odd = ("single_word", "lstrip", "rstrip", "normalized")
        same("added_tokens", [t["content"] for t in spec["added_tokens"] if any(t.get(k) for k in odd)], [])


@lru_cache(4)
def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    Vocabulary.check(json.loads(text))
    return text


class PrefixEncoder:
    """Makes the tables of a vocabulary: the automaton of its tokens and how each token forms."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.text = {i: t for t, i in vocabulary.ids.items()}
        self.formed: dict[str, tuple[int, str, str]] = {}  # each token's last merge: rank, left, right
        self._build()

    def _split(self, token: str) -> tuple[str, ...]:
        end = self.vocabulary.end
        return (*token[: -len(end) - 1], token[-len(end) - 1 :]) if end and token.endswith(end) and len(token) > len(end) else tuple(token)

    def _build(self) -> None:
        """A trie of all tokens that encode to themselves, with failure links to the longest other suffix."""
        self.parts = {i: self._split(t) for t, i in self.vocabulary.ids.items()}
        self.next: list[dict[str, int]] = [{}]
        token = [-1]
        for i, parts in self.parts.items():
            if self.merged(parts) != (self.text[i],):
                continue  # no text encodes to this token
            at = 0
            for s in parts:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    token.append(-1)
                at = self.next[at][s]
            token[at] = i
        self.token = token
        self.fail = [0] * len(self.next)
        self.found = [0] * len(self.next)  # the state of the longest token that is a suffix; the root if there is none
        level = [(s, 0) for s in self.next[0].values()]
        while level:
            below = []
            for at, fail in level:
                self.fail[at] = fail
                self.found[at] = at if token[at] >= 0 else self.found[fail]
                below += [(to, self._step(fail, s)) for s, to in self.next[at].items()]
            level = below
        self.solver = Solver(self.tables())

    def _step(self, state: int, symbol: str) -> int:
        while symbol not in self.next[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.next[state][symbol]

    def merged(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        """The merge procedure itself; used on each token once, to learn how it forms."""
        ranks = self.vocabulary.ranks
        while len(parts) > 1:
            pair = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
            if pair not in ranks:
                break
            if len(parts) == 2:
                self.formed[pair[0] + pair[1]] = (ranks[pair], *pair)
            out, i = [], 0
            while i < len(parts):
                both = i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]
                out.append(pair[0] + pair[1] if both else parts[i])
                i += 2 if both else 1
            parts = tuple(out)
        return parts

    def tables(self) -> Tables:
        v = self.vocabulary
        code = {s: b for b, s in enumerate(byte_symbols())}
        code |= {s + v.end: b + 256 for s, b in code.items()} if v.end else {}
        edges = sorted((at << 9 | code[s], to) for at, below in enumerate(self.next) for s, to in below.items() if s in code)
        pairs = sorted((v.ids[a] << PAIR | v.ids[b], r) for (a, b), r in v.ranks.items())
        n = max([*self.parts, *v.special.values()], default=0) + 1
        names: list[str | None] = [None] * n
        for i, t in [*((i, t) for t, i in v.special.items()), *self.text.items()]:
            names[i] = t
        size, rank, left, right = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, parts in self.parts.items():
            size[i] = len(parts)
            if (form := self.formed.get(self.text[i])) is not None:
                rank[i], left[i], right[i] = form[0], v.ids[form[1]], v.ids[form[2]]
        state = [np.array(x, np.int64) for x in (self.token, self.fail, self.found)]
        edges, pairs = (np.array(x, np.int64).reshape(-1, 2).T.copy() for x in (edges, pairs))
        return Tables(v.pattern.pattern, v.special, bool(v.end), names, edges, pairs, *state, size, rank, left, right)

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        return bool(self.solver.fits(np.array([left]), np.array([right]))[0])


#: Bits of a token's id in the number of a pair.
PAIR = 20


@dataclass(eq=False)
class Tables:
    """Arrays of a vocabulary: the automaton's edges (state and symbol, state) and merges (pair, rank), both sorted; by state
    its token, failure link and state of the longest token; by token its length, and its last merge's rank and parts.

    A symbol is a byte, plus 256 for the last one of a word where the vocabulary marks it.
    """

    pattern: str
    special: dict[str, int]
    marked: bool
    names: list[str | None]
    edges: np.ndarray
    pairs: np.ndarray
    token: np.ndarray
    fail: np.ndarray
    found: np.ndarray
    size: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def __post_init__(self):
        h = hashlib.sha256(repr((self.pattern, self.special, self.marked, self.names)).encode())
        for x in (self.edges, self.pairs, self.token, self.fail, self.found, self.size, self.rank, self.left, self.right):
            h.update(x.tobytes())
        self.digest = h.digest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return isinstance(other, Tables) and self.digest == other.digest


class Memo:
    """Results by key, each in the one place that its key's hash gives it; a result that is gone is worked out again.

    Keys have 39 bits at most, results 24.
    """

    def __init__(self, bits: int, work):
        self.held = np.full(1 << bits, -1, np.int64)
        self.shift, self.work = np.uint64(64 - bits), work

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        got = self.held[at]
        miss = np.flatnonzero(got >> 24 != keys)
        if len(miss):
            new, where = np.unique(keys[miss], return_inverse=True)
            made = (new << 24 | self.work(new))[where]
            got[miss] = self.held[at[miss]] = made
        return got & 0xFFFFFF


def _ranked(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of keys in a sorted table, and which keys it has."""
    if not table.shape[1]:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), table.shape[1] - 1)
    return table[1][at], table[0][at] == keys


class Solver:
    """Encodes words, given as bytes, by the table of last tokens."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.after = tables.found[tables.fail]  # the state of the next shorter token
        self.steps = Memo(18, self._step)
        self.known = Memo(19, self._compatible)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """Where states (shifted by 9 bits) go by their symbols."""
        state, symbol, out = keys >> 9, keys & 511, np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        while len(left):
            to, there = _ranked(self.tables.edges, state[left] << 9 | symbol[left])
            out[left[there]] = to[there]
            left = left[~there & (state[left] > 0)]
            state[left] = self.tables.fail[state[left]]
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens stay as they are side by side, for many."""
        return self.known(left << PAIR | right) == 1

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """Their merges are undone from the last one back. At each point, a merge across the border is due before the one
        just undone if its rank is lower, or equal and more to the left; then the two would not have formed."""
        t = self.tables
        a, b, out = keys >> PAIR, keys & ((1 << PAIR) - 1), np.zeros(len(keys), np.int64)
        limit = np.full(len(keys), 1 << 60)  # the first merge across the border that would come too late
        left = np.arange(len(keys))
        while len(left):
            rank, there = _ranked(t.pairs, a << PAIR | b)
            at_a, at_b = t.rank[a], t.rank[b]
            early, atoms = there & (rank < limit), (at_a < 0) & (at_b < 0)
            out[left[~early & atoms]] = 1
            go = ~early & ~atoms
            left, a, b, at_a, at_b = left[go], a[go], b[go], at_a[go], at_b[go]
            first = at_a > at_b
            limit = np.where(first, at_a, at_b + 1)
            a, b = np.where(first, t.right[a], a), np.where(first, b, t.left[b])
        return out

    def solve(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, not empty, each as unsigned 32-bit numbers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        out: list[bytes] = [b""] * len(words)
        i = 0
        while i < len(order):
            j = i + 1
            if (longest := int(size[order[i]])) <= LONG:
                j = min(len(order), i + max(1, CELLS // (longest + 1)))
                own = order[i:j].tolist()
                ids, ends = self._together([words[k] for k in own], size[order[i:j]])
                for k, a, b in zip(own, [0, *ends], ends, strict=False):
                    out[k] = ids[a:b]
            else:
                out[order[i]] = self._alone(words[order[i]])
            i = j
        return out

    def _together(self, words: list[bytes], n: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids of words from the longest to the shortest, and where those of each end, in bytes."""
        t = self.tables
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(n) - n
        if t.marked:
            symbols[starts + n - 1] += 256
        last = np.full((int(n[0]) + 1, len(n)), -1, np.int32)  # the last token of each prefix
        state = np.zeros(len(n), np.int64)
        live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # words longer than each prefix
        for at, k in enumerate(live.tolist()):
            state = self.steps(state[:k] << 9 | symbols[starts[:k] + at])
            todo, found = np.arange(k), t.found[state]
            while len(todo):
                if not found.all():
                    raise ValueError(f"no token for {words[int(todo[np.argmin(found)])][at : at + 1]!r}")
                token = t.token[found]
                begin = at + 1 - t.size[token]
                ok = begin == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.fits(last[begin[inner], todo[inner]].astype(np.int64), token[inner])
                last[at + 1, todo[ok]] = token[ok]
                todo, found = todo[~ok], self.after[found[~ok]]
        rows, tokens, back = np.arange(len(n)), [], []
        at, counts = n.copy(), np.zeros(len(n), np.int64)
        while len(rows):
            token = last[at[rows], rows]
            tokens.append(token)
            back.append(rows)
            counts[rows] += 1
            at[rows] -= t.size[token]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]), np.uint32)
        for k, (token, rows) in enumerate(zip(tokens, back, strict=True)):
            ids[ends[rows] - 1 - k] = token
        return ids.tobytes(), (ends * 4).tolist()

    def _alone(self, word: bytes) -> bytes:
        """The same for one long word, in memory and time linear in it."""
        t, steps, fits, moves, known = self.tables, self.steps, self.fits, {}, {}
        last, state = np.full(len(word) + 1, -1, np.int32), 0
        token, found_at, after, size = t.token, t.found, self.after, t.size
        for at, symbol in enumerate(word, 1):
            key = state << 9 | symbol + 256 * (t.marked and at == len(word))
            if key not in moves:
                if len(moves) >= STORE:
                    moves.clear()
                moves[key] = int(steps(np.array([key]))[0])
            state = moves[key]
            found = int(found_at[state])
            while found:
                own = int(token[found])
                start = at - int(size[own])
                if not start:
                    break
                pair = int(last[start]), own
                if pair not in known:
                    if len(known) >= STORE:
                        known.clear()
                    known[pair] = bool(fits(np.array([pair[0]]), np.array([own]))[0])
                if known[pair]:
                    break
                found = int(after[found])
            else:
                raise ValueError(f"no token for {symbol!r}")
            last[at] = own
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= int(size[last[at]])
        return np.array(ids[::-1], np.uint32).tobytes()


class TextEncoder:
    """Encodes texts as the tokenizer file says: special tokens, normal form, lower case, split, bytes, merges."""

    def __init__(self, tables: Tables):
        self.solver = Solver(tables)
        self.special = {t: np.uint32(i).tobytes() for t, i in tables.special.items()}
        named = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.between = re.compile(f"({named})") if named else None
        self.odd = f"{named}|[\\x1c-\\x1f]" if named else "[\\x1c-\\x1f]"  # the separators are white space to Arrow alone
        self.pattern = regex.compile(tables.pattern)
        self.names = tables.names
        self.written = pa.array(list(map(str, range(len(self.names))))), pa.array([n or "" for n in self.names], pa.string())
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0

    def _pieces(self, word: str) -> list[str]:
        """The split parts of a word."""
        if word.isascii():  # most words: letters, perhaps with one mark behind them
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
        word = unicodedata.normalize("NFC", word)
        low = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)  # no final sigma
        return self.pattern.findall(low)

    def learn(self, words: Iterable[str]) -> None:
        """Stores the ids of words not stored yet."""
        if len(self.words) > STORE or self.chars > STORE_CHARS:
            self._clear()
        known, pieces = self.words, self.pieces
        new = {w: self._pieces(w) for w in words if w not in known}
        unknown = list({p for ps in new.values() for p in ps if p not in pieces})
        pieces.update(zip(unknown, self.solver.solve([p.encode() for p in unknown]), strict=True))
        known.update({w: pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps]) for w, ps in new.items()})
        self.chars += sum(map(len, new))

    def _odd(self, text: str) -> bytes:
        """The ids of a text that holds special tokens or separators, run by run."""
        runs = [(i % 2, [t] if i % 2 else _UNSPACED.findall(t)) for i, t in enumerate(self.between.split(text) if self.between else [text])]
        self.learn([w for special, ws in runs if not special for w in ws])
        return b"".join([self.special[w] if special else self.words[w] for special, ws in runs for w in ws])

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, none null, and where those of each begin and end. Different words are looked up once a call."""
        odd = pc.match_substring_regex(texts, self.odd)
        some = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if len(some) else texts)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn(words)
        ids = [self.words[w] for w in words]
        pool, size = np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lengths, starts = size[at], (np.cumsum(size) - size)[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = pool[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[bounds - bounds[0]]
        if len(some):
            each = [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for i in some.tolist():
                each[i] = np.frombuffer(self._odd(texts[i].as_py()), np.uint32)
            out, cuts = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return out, cuts

    @staticmethod
    def joined(written: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """What is written for the ids of each text, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), written.take(pa.array(ids))), " ")

    def digests(self, written: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        if len(ids) <= WRITTEN:
            text = self.joined(written, ids, cuts)
            at, data = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1].tolist(), memoryview(text.buffers()[2] or b"")
            return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        out = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            h = hashlib.sha256()
            for i in range(a, b, WRITTEN):
                some = ids[i : min(b, i + WRITTEN)]
                h.update(b" " * (i > a) + self.joined(written, some, np.array([0, len(some)]))[0].as_py().encode())
            out.append(h.hexdigest())
        return out


@lru_cache(4)
def tables(spec: str) -> Tables:
    return PrefixEncoder(Vocabulary(json.loads(spec))).tables()


@lru_cache(2)
def _encoder(made: Tables | str) -> TextEncoder:
    """The worker's encoder, by tables or a tokenizer file's content."""
    return TextEncoder(tables(made) if isinstance(made, str) else made)


LET_GO.append(_encoder.cache_clear)


def _encode(batches: Iterable[pa.RecordBatch], made, text: str, ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(made.value)
    gc.disable()  # the stores hold no cycles
    try:
        yield from _encoded(batches, encoder, text, ids)
    finally:
        gc.enable()


def _encoded(batches: Iterable[pa.RecordBatch], encoder: TextEncoder, text: str, ids: bool) -> Iterator[pa.RecordBatch]:
    for part, _ in chunks(batches, text, 2_000_000):
        texts = part.column(text)
        flat, cuts = encoder.encode_batch(texts)
        names = [n for n in part.schema.names if n != text]
        out = [*(part.column(n) for n in names), pa.array(np.diff(cuts)), *(pa.array(encoder.digests(w, flat, cuts), pa.string()) for w in encoder.written)]
        names = [*names, "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32))))
            out.append(encoder.joined(encoder.written[1], flat, cuts))
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(out, names)


def _decode(batches: Iterable[pa.RecordBatch], made, ids: str) -> Iterator[pa.RecordBatch]:
    names = made.value.names
    for b in batches:
        out = [" ".join([t for i in row or () if i is not None and 0 <= i < len(names) and (t := names[i]) is not None]) for row in b.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of an array of ids: their tokens, special ones too, joined by one space.

    Ids that the vocabulary lacks and nulls are passed over; a null or empty array is the empty text.
    """
    ship(rows.sparkSession)
    made = rows.sparkSession.sparkContext.broadcast(tables(load(path)))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", decoded string"
    return rows.mapInArrow(lambda it: _decode(it, made, ids), schema)


def encode(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with ``ids`` also ids (array) and decoded (text).

    ``path`` is the tokenizer file (its tables go to the executors as a broadcast). Ids are those of encoding
    without added special tokens, where a special token's string inside a text is that token; ``decoded`` is the tokens
    joined by one space, as the file has no decoder. Null and empty texts have no tokens. Repeated rows give repeated
    rows, a null doc_id stays null, an empty table gives an empty result. Texts are whole, of any length.
    """
    ship(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(tables(load(path)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return rows.mapInArrow(lambda it: _encode(it, made, "__text", ids), schema)
