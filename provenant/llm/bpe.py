"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding has a prefix property: cut behind its k-th token, the left
part's own encoding is exactly those k tokens.  So the encoding of a word is fixed
by one state for each of its prefixes, the last token of that prefix, and words with a
common prefix share those states.  Distinct words are put into a trie; a depth-first
walk carries the stack of states and computes each shared prefix once.  At a node the
last token is the one suffix token that stays unmerged behind the state where it
begins: two neighbours are compatible if encoding their concatenation gives just them.

Visiting the words in sorted order and cutting the stack back to the common prefix
with the word before *is* the depth-first walk, without storing nodes.

Decided cases: a null text counts as empty and has no ids; the decoding of no ids is
the empty text; repeated rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import DROPS, byte_slices, map_rows, record, table

#: White space for str.split() but not for the tokenizer's pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The pattern's white space.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Texts with other characters than these, or special tokens, are normalised and split piece by piece:
#: of the others (Latin letters, but for the dotted capital I) lower case changes each character by itself.
_ODD = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"
#: What stands apart from words of letters, in the order of the vocabulary file's pattern.
_APART = r"'(?:s|t|re|ve|m|ll|d)|[^\t-\r \pL\pN]+|\pN"
#: The vocabulary file's pattern that `_APART` is written for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distance of a symbol that ends a word from the same symbol inside it.
_FINAL = 1024
#: Entries that one worker keeps between batches; when there are twice as many, the half not used for longest goes.
CACHE_WORDS = 400_000
_PAIRS = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if visible, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class TrieBpe:
    """A word-level BPE vocabulary file (JSON with end-of-word marks), encoded by trie traversal.

    The normaliser (NFC, white space, lower case) and the word pattern are the file's.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._table = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]
        self._packed = [i.to_bytes(4, "little") for i in range(len(self._table))]
        self._latin = dict(enumerate(_byte_symbols()))
        self._path, self._library = path, None
        self._plain = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _PATTERN
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._right_edge: dict[int, list[tuple[int, int]]] = {}
        self._left_edge: dict[int, list[tuple[int, int]]] = {}
        self._merges_ordered = self._ordered()
        self._automaton()

    # -- merges ---------------------------------------------------------

    def _parts(self, token: str) -> list[str]:
        """Base symbols of a token; the end-of-word mark belongs to the last one."""
        if token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return [*token]

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked neighbour pair merges first, leftmost of equals."""
        parts = parts[:]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _ordered(self) -> bool:
        """Whether each token has one merge that makes it, later than those that make its parts; notes the merges.

        Then the edges of two neighbours tell if a merge across them comes before those inside them.
        """
        self._made: dict[int, tuple[int, int, int]] = {}
        self._across: dict[int, int] = {}
        for (a, b), rank in self.rank.items():
            left, right, whole = (self.vocab.get(x, -1) for x in (a, b, a + b))
            if min(left, right, whole) < 0 or whole in self._made:
                return False
            if any(x not in self._made and len(self._parts(self.tokens[x])) > 1 for x in (left, right)):
                return False
            self._made[whole] = rank, left, right
            self._across[left << 20 | right] = rank
        return True

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """A token's parts at its left (1) or right (2) edge, each with the rank of the merge that takes it up."""
        out, rank = [], 1 << 60
        while True:
            out.append((token, rank))
            made = self._made.get(token)
            if made is None:
                return out
            rank, token = made[0], made[side]

    def _crossed(self, left: int, right: int) -> bool:
        """Whether a merge across two neighbours comes first; of equal ones inside and across, the leftmost does."""
        for edges, token, side in ((self._right_edge, left, 2), (self._left_edge, right, 1)):
            if token not in edges:
                edges[token] = self._edge(token, side)
        across = self._across
        for a, until in self._right_edge[left]:
            for b, end in self._left_edge[right]:
                rank = across.get(a << 20 | b)
                if rank is not None and rank < until and rank <= end:
                    return True
        return False

    def _compatible(self, left: int, right: int) -> bool:
        if len(self._fits) > _PAIRS:
            self._fits.clear()
        if self._merges_ordered:
            got = self._whole(left) and self._whole(right) and not self._crossed(left, right)
        else:
            a, b = self.tokens[left], self.tokens[right]
            got = self.merge(self._parts(a) + self._parts(b)) == [a, b]
        self._fits[left << 20 | right] = got
        return got

    def _whole(self, token: int) -> bool:
        if token in self._alone:
            return self._alone[token]
        got = self._alone[token] = self.merge(self._parts(self.tokens[token])) == [self.tokens[token]]
        return got

    # -- suffix tokens ----------------------------------------------------

    def _automaton(self) -> None:
        """Aho-Corasick over the vocabulary: each prefix's suffixes that are tokens, longest first.

        A symbol that ends a word is another symbol, `_FINAL` higher, than inside it.
        """
        step: dict[int, int] = {}
        node_of: dict[int, int] = {}
        edges: list[list[tuple[int, int]]] = [[]]
        length = [0] * len(self._table)
        for text, token in self.vocab.items():
            if token in self.special.values():
                continue
            codes = [ord(c) for c in text.removesuffix(self.end)]
            if text.endswith(self.end) and codes:
                codes[-1] += _FINAL
            node = 0
            for c in codes:
                at = step.get(node << 12 | c)
                if at is None:
                    at = step[node << 12 | c] = len(edges)
                    edges[node].append((c, at))
                    edges.append([])
                node = at
            node_of[node] = token
            length[token] = len(codes)
        fail = [0] * len(edges)
        ending: list[tuple[tuple[int, int], ...]] = [((node_of[k], length[node_of[k]]),) if k in node_of else () for k in range(len(edges))]
        queue = [0]
        for node in queue:
            for c, at in edges[node]:
                back = fail[node]
                while back and back << 12 | c not in step:
                    back = fail[back]
                fail[at] = step.get(back << 12 | c, 0) if node else 0
                ending[at] += ending[fail[at]]
                queue.append(at)
        self._step, self._fail, self._ending, self._length = step, fail, ending, length

    def _next(self, state: int, code: int) -> int:
        """The transition that the trie lacks; it is remembered."""
        back = state
        while back and back << 12 | code not in self._step:
            back = self._fail[back]
        got = self._step[state << 12 | code] = self._step.get(back << 12 | code, 0)
        return got

    # -- trie -----------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed token ids of distinct words, given as byte symbols, by one depth-first traversal."""
        step, ending, length = self._step, self._ending, self._length
        fits, alone, packed = self._fits, self._alone, self._packed
        out: dict[str, bytes] = {}
        before = ""
        last, states = [0], [0]  # of the prefix of i symbols: its last token and its automaton state
        push, push_state = last.append, states.append
        for word in sorted(set(words)):
            n = len(word)
            shared, most = 0, min(n, len(last)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for code in map(ord, word[shared:]):
                end += 1
                key = state << 12 | (code + _FINAL if end == n else code)
                state = step[key] if key in step else self._next(state, key & 4095)
                for token, size in ending[state]:
                    if size == end:
                        if alone[token] if token in alone else self._whole(token):
                            break
                    else:
                        pair = last[end - size] << 20 | token
                        if fits[pair] if pair in fits else self._compatible(pair >> 20, token):
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                push(token)
                push_state(state)
            token = last.pop()
            states.pop()
            if length[token] == n:
                out[word] = packed[token]
            else:
                ids = [packed[token]]
                n -= length[token]
                while n:
                    token = last[n]
                    ids.append(packed[token])
                    n -= length[token]
                ids.reverse()
                out[word] = b"".join(ids)
            before = word
        return out

    # -- words of a text --------------------------------------------------

    def _split(self, piece: str) -> list[str]:
        """Normalised words, as byte symbols, of a stretch of text without white space."""
        if piece.isascii():
            piece = piece.lower()
            if piece.isalpha():
                return [piece]
            if piece[-1] in ".,!?;:" and piece[:-1].isalpha():
                return [piece[:-1], piece[-1]]
            words = self._word.findall(piece)
            return words if piece.isprintable() else [w.translate(self._latin) for w in words]
        if max(piece) >= "\u0250":  # beyond Latin letters Unicode versions may disagree
            return self._by_library(piece)
        piece = unicodedata.normalize("NFC", piece).lower()
        words = [piece] if piece.isalpha() else self._word.findall(piece)
        return [w.encode().decode("latin-1").translate(self._latin) for w in words]

    def _by_library(self, piece: str) -> list[str]:
        """Normalising and splitting (not merging) of rarer scripts by the tokenizers library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        lib = self._library
        return [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(piece)) if w]

    def _pieces(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return _SPACES.split(text)
        return text.split()

    def _stretches(self, text: str) -> list[str]:
        """Pieces between white space; texts of special tokens stand alone."""
        if self._special is None or "<|" not in text or not self._special.search(text):
            return self._pieces(text)
        out = []
        for part in self._special.split(text):
            out += [part] if part in self.special else self._pieces(part)
        return out

    def _ids(self, pieces: list[str], split: Callable[[str], list[str]] | None = None) -> list[bytes]:
        """Packed ids of distinct pieces, words if there is no `split`; unknown ones are encoded in one traversal."""
        if len(self.cache) > CACHE_WORDS:
            self._older, self.cache = self.cache, {}
        cache, older = self.cache, self._older
        new = [p for p in pieces if p not in cache]
        if older:
            cache.update((p, older[p]) for p in new if p in older)
            new = [p for p in new if p not in older]
        if split:
            words = [split(p) for p in new]
            ids = self.encode_words(w for own in words for w in own)
            cache.update((p, b"".join([ids[w] for w in own])) for p, own in zip(new, words, strict=True))
        else:
            words = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self._latin) for p in new if p]
            ids = self.encode_words(words)
            cache.update(zip(filter(None, new), map(ids.__getitem__, words), strict=True))
            cache[""] = b""
        return list(map(cache.__getitem__, pieces))

    def _piece(self, piece: str) -> list[str]:
        return self._split(piece) if piece else []

    def _encode_odd(self, texts: list[str]) -> list[bytes]:
        stretches = [self._stretches(t) for t in texts]
        distinct = list({p for s in stretches for p in s if p not in self.special})
        ids = dict(zip(distinct, self._ids(distinct, self._piece), strict=True))
        ids |= {p: self._packed[i] for p, i in self.special.items()}
        return [b"".join(map(ids.__getitem__, s)) for s in stretches]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and the places where each text's begin and end; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD) if self._plain else pa.repeat(True, len(texts))
        some = pc.any(odd).as_py()
        plain = pc.if_else(odd, "", texts) if some else texts
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _APART, r" \0 "))
        coded = words.flatten().dictionary_encode()
        known = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(np.frombuffer(b"".join(known), "<u4")))
        taken = lists.take(coded.indices)
        ids = taken.flatten().to_numpy()
        bounds = taken.offsets.to_numpy()[words.offsets.to_numpy()]
        if not some:
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for k, own in zip(which, self._encode_odd([texts[k].as_py() for k in which]), strict=True):
            parts[k] = np.frombuffer(own, "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens, joined by a space: the file names no decoder that would fuse them."""
        return b" ".join(map(self._table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieBpe:
    """One encoder, with its caches, for each worker process."""
    return TrieBpe(path)


DROPS.append(encoder.cache_clear)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids binary, decoded string) of every text; `vocabulary` is a path that every executor has."""
    return _encoded(docs, vocabulary, lambda ids, text: (ids, text.decode()), "ids binary, decoded string")


def _encoded(docs: DataFrame, vocabulary: str | None, cells: Callable[[bytes, bytes], tuple], schema: str) -> DataFrame:
    """doc_id and the `cells` of every text's ids and their decoding."""
    path = vocabulary or default_vocabulary()
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    columns = [c.split() for c in schema.split(", ")]

    def make():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in byte_slices(batch, 1):
                ids = bpe.encode(part.column(1))
                rows = zip(*(cells(x, bpe.decode(x)) for x in ids), strict=True)
                yield record(doc_id=part.column(0), **{c: pa.array(x, kinds[k]) for (c, k), x in zip(columns, rows, strict=True)})

        return step

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id long, {schema}", rows=1 << 20, keep=True)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""

    def cells(ids: bytes, text: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return _encoded(table(spark, sf_dir, "documents"), None, cells, "n_tokens long, ids_sha256 string, decoded_sha256 string")
