"""Byte-pair encoding of whole texts by backtracking, and decoding by an offset table.

A token sequence is the merge result of its text exactly if every two neighbours are compatible: no
merge would have joined them across their border.  So a word is encoded from the left by the longest
token that matches (Aho-Corasick gives it for every position), is compatible with the token before
and does not end where no continuation was found; else the next shorter token is tried, and if there
is none the token before is taken back.  The encoding of a prefix is unique, so each position fails
at most once and the time is linear.

The tokenizer file is a parameter; the installed library only normalises text that is not ASCII and
says once for each character what kind the file's pattern takes it for.
"""

from __future__ import annotations

import json
import re
from functools import cached_property
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C

END = "Ā"                  # stands for the end of a word; bytes are the characters below it
CACHE = 150_000                 # encoded words that a worker remembers
PAIRS = 400_000               # pair verdicts that a worker remembers
SLICE_BYTES = 1 << 20           # text that is encoded at once
SPACE, LETTER, NUMBER, SYMBOL, MARK = range(5)
FIRST_MARK = 0xF8               # bytes from here on never occur in UTF-8; they stand for special tokens
#: FIXED VALUES: the split pattern and the steps that this module carries out
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]


def byte_alphabet() -> dict[str, str]:
    """The printable character that byte-level vocabularies write for each byte -> that byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + n): chr(b) for n, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the compatibility of token pairs."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        import ahocorasick

        back = byte_alphabet()

        def raw(token: str) -> str:
            stem = token[:-len(suffix)] if token.endswith(suffix) else token
            return "".join(back[c] for c in stem) + (END if stem is not token else "")

        n = max(vocab.values()) + 1
        self.left, self.right = [-1] * n, [-1] * n
        self.rank, self.length, self.prefix = [-1] * n, [0] * n, [-1] * n
        self.merge: dict[int, int] = {}
        text = {}
        for token, i in vocab.items():
            text[raw(token)] = i
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.rank[i] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError(f"merge {r} makes a token twice, or before its parts")
            self.left[i], self.right[i], self.rank[i] = a, b, r
            self.merge[a << 32 | b] = r
        self._tails: dict[int, list[int]] = {}
        self._heads: dict[int, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        reached = [True] * n                        # a token that merging its own text does not give never occurs
        for i in sorted(vocab.values(), key=lambda i: self.rank[i]):
            if self.rank[i] >= 0:
                a, b = self.left[i], self.right[i]
                reached[i] = reached[a] and reached[b] and self._joins(a, b) == self.rank[i]
        text = {t: i for t, i in text.items() if reached[i]}
        self.automaton = ahocorasick.Automaton()
        for t, i in text.items():
            self.length[i] = len(t)
            self.prefix[i] = next((text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in text), -1)
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()

    def _spine(self, token: int, side: list[int], known: dict[int, list[int]]) -> list[int]:
        """The pieces of ``token`` at one border, in the order in which merging makes them."""
        got = known.get(token)
        if got is None:
            got, at = [], token
            while at >= 0:
                got.append(at)
                at = side[at]
            got.reverse()
            known[token] = got
        return got

    def _joins(self, a: int, b: int) -> int | None:
        """The rank of the merge that joins the neighbours ``a`` and ``b`` across their border, or None.

        Both grow towards their full length in the order of ranks.  The pieces at the border are
        joined as soon as their merge comes before the next merge of either; of equal ranks the one
        further left comes first, which is the left piece's own, but not the right one's.
        """
        tails, heads = self._spine(a, self.right, self._tails), self._spine(b, self.left, self._heads)
        i = j = 0
        never = len(self.merge)
        while True:
            next_a = self.rank[tails[i + 1]] if i + 1 < len(tails) else never
            next_b = self.rank[heads[j + 1]] if j + 1 < len(heads) else never
            r = self.merge.get(tails[i] << 32 | heads[j])
            if r is not None and r < next_a and r <= next_b:
                return r
            if next_a == never and next_b == never:
                return None
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get(a << 32 | b)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a << 32 | b] = self._joins(a, b) is None
        return got

    def encode(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of each word (characters below ``END``, at least one)."""
        joined = END.join(words) + END
        longest = [-1] * len(joined)
        length = self.length
        for end, token in self.automaton.iter(joined):
            longest[end - length[token] + 1] = token          # later ends are longer matches
        out, start = [], 0
        for word in words:
            end = start + len(word) + 1
            out.append(self._backtrack(longest, start, end))
            start = end
        return out

    def _backtrack(self, longest: list[int], start: int, end: int) -> tuple[int, ...]:
        length, prefix, pairs = self.length, self.prefix, self.pairs
        done: list[int] = []
        dead: set[int] = set()
        at, token = start, longest[start]
        while at < end:
            if token < 0:
                if not done:
                    raise ValueError("a character of the text is not in the vocabulary")
                dead.add(at)
                last = done.pop()
                at -= length[last]
                token = prefix[last]
                continue
            stop = at + length[token]
            if stop not in dead:
                fits = True
                if done:
                    fits = pairs.get(done[-1] << 32 | token)
                    if fits is None:
                        fits = self.compatible(done[-1], token)
                if fits:
                    done.append(token)
                    at = stop
                    token = longest[at] if at < end else -1
                    continue
            token = prefix[token]
        return tuple(done)


class Tokenizer:
    """A tokenizer file of byte-level tokens with word ends, lower case, as this module carries it out."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None or spec["post_processor"] is not None
                or [s["type"] for s in steps] != STEPS or split["pattern"].get("Regex") != PATTERN):
            raise ValueError(f"{path} is not of the kind of tokenizer that is carried out here")
        self.model = model
        self.library = Library.from_file(path)
        self.normaliser = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(added) > 256 - FIRST_MARK:
            raise ValueError("too many added tokens")
        self.marks = {t: FIRST_MARK + n for n, t in enumerate(added)}
        self.mark_id = {chr(FIRST_MARK + n): i for n, i in enumerate(added.values())}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in added.items()}
        size = max(tokens) + 1
        shown = [tokens[i].encode() + b" " if i in tokens else b"" for i in range(size)]
        self.table = np.frombuffer(b"".join(shown), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in shown])]).astype(np.int64)
        self.kind = np.full(0x110000, -1, np.int8)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.learn(np.arange(128))

    @cached_property
    def vocabulary(self) -> Vocabulary:
        """Only encoding needs it."""
        model, self.model = self.model, None
        return Vocabulary(model["vocab"], model["merges"], model["end_of_word_suffix"])

    def learn(self, points: np.ndarray) -> None:
        """Ask the file's pattern what kind of character each unknown code point is."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        for p in points[self.kind[points] < 0].tolist():
            c = chr(p)
            if len(pieces("a" + c)) == 1 and pieces(c):
                self.kind[p] = LETTER
            else:
                self.kind[p] = (SPACE, SYMBOL, NUMBER)[len(pieces(c + c))]

    def normal(self, text: bytes) -> bytes:
        """Normal form of one text, special tokens as their marks."""
        s = text.decode("utf-8", "replace")
        out, at = [], 0
        for hit in self.special.finditer(s) if self.special else ():
            out += [self.normaliser.normalize_str(s[at:hit.start()]).encode(), bytes([self.marks[hit.group()]])]
            at = hit.end()
        return b"".join([*out, self.normaliser.normalize_str(s[at:]).encode()])

    def normal_texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hard = C.per_text(data >= 128, offs) > 0
        raw = data.tobytes()
        if self.special:
            at = [m.start() for m in re.finditer(self.special.pattern.encode(), raw)]
            row = np.searchsorted(offs, at, "right") - 1
            hard[row] = True
        low = self.lower[data]
        if not hard.any():
            return low, offs
        low = low.tobytes()
        texts = [self.normal(raw[a:b]) if h else low[a:b] for h, a, b in zip(hard.tolist(), offs[:-1].tolist(), offs[1:].tolist())]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """Kind of the character that each byte belongs to."""
        out = self.kind[np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        if not len(lead):
            return out
        b = np.zeros((4, len(lead)), np.int64)
        for k in range(4):
            inside = lead + k < len(data)
            b[k, inside] = data[lead[inside] + k]
        more = b[1:] & 0x3F
        size = np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4))
        point = np.select([size == 2, size == 3],
                          [(b[0] & 0x1F) << 6 | more[0], (b[0] & 0x0F) << 12 | more[0] << 6 | more[1]],
                          (b[0] & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2])
        mark = b[0] >= FIRST_MARK
        point[mark] = 0
        self.learn(np.unique(point))
        kind = np.where(mark, MARK, self.kind[point])
        size[mark] = 1
        for k in range(4):
            here = size > k
            out[lead[here] + k] = kind[here]
        return out

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces that the pattern cuts normal texts into."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kind = self.kinds(data)
        edge = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        edge[:n] |= ((kind == NUMBER) & (data & 0xC0 != 0x80)) | (kind == MARK)
        edge[offs] = True
        quote = np.flatnonzero((data[:-1] == 0x27) & edge[:n - 1] & edge[1:n] & (kind[1:] == LETTER))
        quote = quote[~np.isin(quote + 1, offs)]
        one = np.isin(data[quote + 1], np.frombuffer(b"stmd", np.uint8))
        short = quote[one]
        rest = quote[~one]
        rest = rest[rest + 2 < n]
        rest = rest[~np.isin(rest + 2, offs)]
        pair = data[rest + 1].astype(np.int64) << 8 | data[rest + 2]
        long = rest[np.isin(pair, [ord(s[0]) << 8 | ord(s[1]) for s in ("re", "ve", "ll")])]
        edge[np.concatenate([short, long]) + 1] = False
        edge[np.concatenate([short + 2, long + 3])] = True
        at = np.flatnonzero(edge)
        keep = kind[at[:-1]] != SPACE
        return at[:-1][keep], at[1:][keep]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = []
        for w in words:
            if w not in self.cache:
                special = self.mark_id.get(w)
                if special is None:
                    new.append(w)
                else:
                    self.cache[w] = (special,)
        if new:
            self.cache.update(zip(new, self.vocabulary.encode(new)))
        return [self.cache[w] for w in words]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, offsets) of a slice of texts."""
        data, offs = self.normal_texts(data, offs)
        starts, ends = self.words(data, offs)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        _, first, which = np.unique(C.SpanHash(data)(starts, ends), return_index=True, return_inverse=True)
        text = data.tobytes().decode("latin-1")
        if C.same_bytes(data, starts, ends, starts[first][which], ends[first][which]):
            words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        else:                                       # two words of one hash in this slice: number the words themselves
            number: dict[str, int] = {}
            which = np.array([number.setdefault(text[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())])
            words = list(number)
        tokens = self.encode_words(words)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.uint32, int(sizes.sum()))
        ids = flat[C.gather(np.cumsum(sizes) - sizes, sizes, which)]
        per_word = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, per_word[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The tokens of each sequence with a blank between them; ids that no token has give nothing."""
        ids = ids.astype(np.int64)
        ids = np.where(ids < len(self.offset) - 1, ids, len(self.offset) - 1)
        start = self.offset[ids]
        size = self.offset[np.minimum(ids + 1, len(self.offset) - 1)] - start
        out = self.table[C.gather(start, size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offs].tolist()
        return [out[a:max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "tokens") -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_tokens long, ids binary) more: the whole text's token ids, without added tokens.

    ``ids`` are little-endian unsigned 32-bit integers, as token files hold them (``as_array`` for an
    array).  ``path`` is the tokenizer file, which every executor must have.  A null or empty text has
    no tokens; strings of special tokens in a text are those tokens, as in the library.  Repeated rows
    and columns of any name pass through; an empty table gives none.  Returns the frame and the
    (unused) name of the struct.
    """
    def make(data, offs):
        sizes, packed = [], []
        for _, _, part, own in C.slices(data, offs, SLICE_BYTES):
            ids, at = load(path).encode(part, own)
            raw = ids.astype("<u4").tobytes()
            sizes += np.diff(at).tolist()
            packed += [raw[4 * a:4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return sizes, packed

    return C.add_columns(docs, text, [("n_tokens", "long"), ("ids", "binary")], make, name)


def decode(docs: DataFrame, path: str, ids: str, name: str = "decoded") -> tuple[DataFrame, str]:
    """``docs`` with a struct (text string) more, decoded from the packed column ``ids`` of ``encode``.

    The file names no decoder, so, as in the library, the tokens stand as the vocabulary writes them
    with a blank between.  Null: an empty text; ids that no token has give nothing.
    """
    def make(data, offs):
        packed = np.frombuffer(data.tobytes(), "<u4")
        return ([t.decode() for t in load(path).decode(packed, offs // 4)],)

    return C.add_columns(docs, ids, [("text", "string")], make, name)


def as_array(ids):
    """Packed ids as array<long>."""
    digits = F.hex(ids)
    part = lambda i, k: F.substring(digits, i * 8 + 1 + 2 * k, F.lit(2))
    one = lambda i: F.conv(F.concat(*[part(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<long>"))
