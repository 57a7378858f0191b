"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-pair encoding is right exactly when every two neighbouring tokens are: the encoding of a word's
prefix is therefore known from its last token alone. The distinct new words of a slice of documents go
into a trie; a depth-first walk gives each node the last token of its prefix's encoding, found among the
tokens that end there as the one that the prefix's rest can precede. What words share is computed once.
Word ends are symbols of their own (``suffix``), so a word's last symbol hangs below the trie as a leaf.

Defined cases: a null or empty text has no token and decodes to the empty text; white space alone
likewise; special strings inside a text are single tokens, as the tokenizers library has them by
default; a word of any length is walked in time linear in it, beyond ``LONG`` symbols outside the trie.
Rows are never merged, so repeated rows and repeated ids each keep their own result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Generations, quiet_worker, slices

#: Words of more symbols than this do not enter the trie, whose paths stay short.
LONG = 256
#: Distinct new words in one trie; chunks and words that a worker keeps; characters and texts whose new words share a trie.
TRIE_WORDS, KEPT, KEPT_WORDS = 40_000, 300_000, 250_000
#: Seams and last tokens that a worker remembers.
SEAMS, HINTS = 600_000, 400_000
SLICE_CHARS, SLICE_ROWS = 4_000_000, 4_096

#: White space of the Unicode property White_Space, as a regular-expression class.
WHITE = "\t-\r \x85\xa0  -     　"


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies spell bytes: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A BPE vocabulary with its merges, answering which token may follow which."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.spelling = {i: s for s, i in vocab.items()}
        self.rank, made = {}, {}
        for r, (a, b) in enumerate(merges):
            if a in vocab and b in vocab and a + b in vocab:
                self.rank.setdefault((vocab[a], vocab[b]), r)
                made.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.made = made
        bare = lambda s: s.removesuffix(suffix) if suffix else s
        self.length = {i: len(bare(s)) for s, i in vocab.items()}
        self.bare = {i: bare(s) for s, i in vocab.items()}
        self.longest = max(self.length.values(), default=1)
        self.hints: dict[tuple, int] = {}
        self._after, self._whole, self._right, self._left = {}, {}, {}, {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token's merge tree, each with the rank of the merge that consumes it."""
        known = self._left if side == 0 else self._right
        if (out := known.get(token)) is None:
            out, t, until = [], token, float("inf")
            while True:
                out.append((t, until))
                if t not in self.made:
                    break
                *parts, until = self.made[t]
                t = parts[side]
            known[token] = out
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's joined text is a, b: no merge across the seam comes before those inside.

        On equal ranks the leftmost pair merges first: the one inside a before the seam, the seam before the one inside b.
        """
        key = a << 32 | b
        if (ok := self._after.get(key)) is None:
            ok = self.whole(a) and self.whole(b)
            if ok:
                right, left, rank = self._spine(a, 1), self._spine(b, 0), self.rank
                ok = not any((r := rank.get((x, y))) is not None and r < x_until and r <= y_until for x, x_until in right for y, y_until in left)
            if len(self._after) > SEAMS:
                self._after.clear()
            self._after[key] = ok
        return ok

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        if (ok := self._whole.get(token)) is None:
            ok = self._whole[token] = token not in self.made or self._made_alone(token)
        return ok

    def _made_alone(self, token: int) -> bool:
        spelled = self.spelling[token]
        end = self.suffix if self.suffix and spelled.endswith(self.suffix) else ""
        text = spelled.removesuffix(end) if end else spelled
        parts = [self.vocab[c] for c in text[:-1]] + [self.vocab[text[-1] + end]]
        while len(parts) > 1:
            best = min(((self.rank.get(p, float("inf")), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(float("inf"), 0))
            if best[0] == float("inf"):
                return False
            i = best[1]
            parts[i : i + 2] = [self.vocab[self.spelling[parts[i]] + self.spelling[parts[i + 1]]]]
        return parts == [token]

    def last(self, word: str, n: int, end: str, states: list[int]) -> int:
        """The last token of the encoding of word[:n] (+ end), given the last tokens of all its shorter prefixes.

        Just one token that ends here can stand last, so what stood here after the same token is tried first.
        """
        hint = (states[n - 1], word[n - 1], end)
        t = self.hints.get(hint)
        if t is not None:
            size = self.length[t]
            if size <= n and self.bare[t] == word[n - size : n] and (self.follows(states[n - size], t) if size < n else self.whole(t)):
                return t
        get, follows = self.vocab.get, self.follows
        for size in range(1, min(n, self.longest) + 1):
            t = get(word[n - size : n] + end)
            if t is not None and (follows(states[n - size], t) if size < n else self.whole(t)):
                if len(self.hints) > HINTS:
                    self.hints.clear()
                self.hints[hint] = t
                return t
        raise ValueError(f"no token of the vocabulary ends {word[max(0, n - 20) : n]!r}")

    def _unwind(self, last: int, n: int, states: list[int]) -> list[int]:
        out = [last]
        while (n := n - self.length[out[-1]]) > 0:
            out.append(states[n])
        return out[::-1]

    def alone(self, word: str) -> list[int]:
        """The encoding of one word outside a trie."""
        states, n = [-1], len(word)
        for i in range(1, n):
            states.append(self.last(word, i, "", states))
        return self._unwind(self.last(word, n, self.suffix, states), n, states)

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """The encodings of distinct, non-empty words, spelled in the byte alphabet.

        The trie is laid out as its words in order: neighbours share a path from the root as far as they agree, and
        reading on is the depth-first walk. States of a shared path stay, each node gets its own just once.
        """
        out = {w: self.alone(w) for w in words if len(w) > LONG}
        trie = sorted(w for w in words if len(w) <= LONG)
        last, end, unwind, length = self.last, self.suffix, self._unwind, self.length
        states, before = [-1], ""
        for w in trie:
            n, k = len(w), 1
            most = min(len(states), n)
            while k < most and w[k - 1] == before[k - 1]:
                k += 1
            del states[k:]
            for i in range(k, n):
                states.append(last(w, i, "", states))
            final = last(w, n, end, states)
            out[w] = unwind(final, n, states) if length[final] < n else [final]
            before = w
        return out


class WordEncoder:
    """Texts to ids and back for one tokenizer file of the kind ``word_bpe``: lower case, white space dropped, word ends."""

    def __init__(self, path: str, kept: int = KEPT):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelling = self.merges.spelling | {i: s for s, i in self.special.items()}
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(parts[0]["pattern"]["Regex"].replace(r"\s", WHITE) + r"|\n").findall
        self.white = re.compile(f"[{WHITE}]+".replace("\t-\r ", ""))
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_alphabet()
        self.number = {i: str(i) for i in self.spelling}
        self.cache, self.known_words = Generations(kept), Generations(KEPT_WORDS)

    def _normal(self, chunk: str) -> str:
        """Composed, then lower-cased character by character: a final sigma has no form of its own."""
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _add_words(self, words) -> None:
        """Put the encodings of words that aren't known yet into the cache of words."""
        kept, letters = self.known_words, self.letters
        new = kept.missing(words)
        for i in range(0, len(new), TRIE_WORDS):
            spelled = {w.encode().decode("latin-1").translate(letters): w for w in new[i : i + TRIE_WORDS]}
            for s, ids in self.merges.encode(list(spelled)).items():
                kept.young[spelled[s]] = tuple(ids)

    def _spaced(self, text: str) -> str:
        """The text with ASCII spaces for all other white space beyond ASCII and on both sides of special strings."""
        if not text.isascii():
            text = self.white.sub(" ", text)
        return self.at_special.sub(r" \1 ", text) if self.at_special and any(s in text for s in self.special) else text

    def encode(self, texts: list[str], forms: tuple[str, ...] = ("ids",)) -> dict[str, pa.Array]:
        """For each text the FORMS asked for: ``n_tokens``, ``ids``, ``ids_text`` and ``decoded``.

        A form is made once for each distinct chunk of white space to white space; a text's is its chunks' in a row.
        An empty text has one chunk, the empty one.
        """
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(map(self._spaced, texts), pa.string())))
        every = split.flatten().dictionary_encode()
        distinct = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := self.cache.missing(distinct):
            self._add_chunks(new)
        young = self.cache.young
        coded, places, ends = [young[c] for c in distinct], every.indices, split.offsets.to_numpy()
        return {f: FORMS[f](self, coded, places, ends) for f in forms}

    def _add_chunks(self, new: list[str]) -> None:
        """Put the ids of chunks that aren't known yet into the cache of chunks."""
        young = self.cache.young
        for c in self.special.keys() & set(new):
            young[c] = (self.special[c],)
        plain = [c for c in new if c not in self.special]
        if not plain:
            return
        # One search over all new chunks, which hold no line feed, gives the words of each between two of them.
        words = self.words("\n".join(map(self._normal, plain)))
        words.append("\n")
        self._add_words([w for w in words if w != "\n"])
        known, ids, at = self.known_words.young, (), 0
        for w in words:
            if w != "\n":
                ids = ids + known[w] if ids else known[w]
            else:
                young[plain[at]] = ids
                ids, at = (), at + 1

    def decode(self, ids) -> str:
        """The tokens' spellings joined by one space: this vocabulary's file names no decoder."""
        return " ".join(self.spelling[i] for i in ids if i in self.spelling)


@cache
def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, with what it has learned in earlier tasks."""
    return WordEncoder(path)


def _n_tokens(encoder, coded, places, ends) -> pa.Array:
    before = np.r_[0, np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))[places.to_numpy()])]
    return pa.array(before[ends[1:]] - before[ends[:-1]])


def _ids(encoder, coded, places, ends) -> pa.Array:
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))))
    before = np.r_[0, np.cumsum(sizes[places.to_numpy()])]
    return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), lists.take(places).flatten())


def _joined(coded: list[str], places, ends) -> pa.Array:
    """Each text's strings joined by one space; a chunk without tokens has no place in it."""
    strings = pa.array(coded, pa.string()).take(places)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), " ")


def _ids_text(encoder, coded, places, ends) -> pa.Array:
    number = encoder.number
    return _joined([" ".join([number[t] for t in ids]) for ids in coded], places, ends)


def _decoded(encoder, coded, places, ends) -> pa.Array:
    spelling = encoder.spelling
    return _joined([" ".join([spelling[t] for t in ids]) for ids in coded], places, ends)


FORMS = {"n_tokens": _n_tokens, "ids": _ids, "ids_text": _ids_text, "decoded": _decoded}
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_text": "string", "decoded": "string"}


def bpe_encode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The columns ``keep`` of docs with the chosen OUTPUTS of the encoding of each whole text, row for row.

    ids_text has the decimal ids joined by one space; decoded is what the ids decode to. Narrow: no shuffle.
    """
    own = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs)])
    n_keep = len(keep)

    def work(batches):
        quiet_worker()
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            for at, texts in slices(batch, n_keep, SLICE_CHARS, SLICE_ROWS):
                made = encoder.encode(texts, outputs)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:n_keep], *made.values()], names=[*keep, *outputs])

    return own.mapInArrow(work, schema)
