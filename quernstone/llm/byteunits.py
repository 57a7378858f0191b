"""Space-led units of a text, for byte-level BPE files whose pre-tokens take one space before a word.

A unit is a maximal run of whole pre-tokens that begins at the text's start or at a single space: every
unit border is a pre-token border, so a text's ids are its units' ids in a row. Texts in which a white
space run could straddle such a border are cut into the pre-tokens themselves.

Units of common characters are merged by tiktoken over the ranks that the tokenizers file gives, which is
several times as fast; the tests hold it against the tokenizers library, which encodes all other units.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

from .bpe import WHITE, byte_alphabet
from .common import Generations

#: The pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteUnits:
    """Cuts texts into units and encodes units with the tokenizers library.

    A unit's key is the text after its space, or a 1-tuple of its text where no space leads it.
    """

    #: A space with white space, or the text's end, after it and white space before it.
    ODD = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pre_tokens = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall

    def of(self, text: str) -> list:
        if self.at_special and any(s in text for s in self.special):
            return list(chain.from_iterable([(p,)] if p in self.special else self._plain(p) for p in self.at_special.split(text) if p))
        return self._plain(text) if text else []

    def _plain(self, text: str) -> list:
        if self.ODD.search(text):
            return [(p,) for p in self.pre_tokens(text)]
        units = text.split(" ")
        if units[0]:
            units[0] = (units[0],)
        else:
            del units[0]
        return units

    #: Characters whose classes differ between no two Unicode versions in use; others are left to the tokenizers library.
    BEYOND = re.compile("[^\x00-\u024f]")

    def engine(self):
        """The file's merges as a rank table for tiktoken, with each token's length in bytes; none where ids don't follow the merges."""
        if not hasattr(self, "_engine"):
            import json

            import numpy as np
            import tiktoken

            model = json.loads(self.model.to_str())["model"]
            letters = {c: b for b, c in byte_alphabet().items()}
            merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
            ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in letters for c in t) and t not in self.special}
            if merged == sorted(set(merged)) and len(ranks) == 256 + len(merged) and not model.get("ignore_merges"):
                sizes = np.zeros(max(ranks.values()) + 1, np.int64)
                for t, i in ranks.items():
                    sizes[i] = len(t)
                self._engine = (tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
            else:
                self._engine = None
        return self._engine

    #: White space other than a plain space, which is left to the tokenizers library as well.
    UNUSUAL = re.compile("[^\x00-\x08\x0e-\x1b -\x84\x86-\x9f\xa1-\u024f\n]")

    def whole(self, text: str):
        """The ids of a whole plain text as numbers, by the engine; None where the text isn't plain."""
        if not text or not self.engine() or self.UNUSUAL.search(text) or any(s in text for s in self.special):
            return None
        return self.engine()[0].encode_to_numpy(text)

    def encoded(self, units: list):
        """(units, their ids in a row, where each unit's ids end), all units being covered by some of the triples.

        Plain units are encoded joined, and cut where the tokens' bytes reach the units' bytes.
        """
        import numpy as np

        plain, rest = [], units
        if self.engine():
            plain = [u for u in units if type(u) is str and u and not u[0].isspace() and not u[-1].isspace() and (u.isascii() or not self.BEYOND.search(u))]
            if plain:
                encoding, sizes = self.engine()
                ids = encoding.encode_to_numpy(" " + " ".join(plain))
                ends = np.cumsum(sizes[ids])
                borders = np.cumsum(np.fromiter(map(len, map(str.encode, plain)), np.int64, len(plain)) + 1)
                cut = np.searchsorted(ends, borders)
                if len(ids) and cut[-1] == len(ids) - 1 and (ends[cut] == borders).all():
                    yield plain, ids, cut + 1
                    done = set(plain)
                    rest = [u for u in units if u not in done]
        if rest:
            each = self.ids(rest)
            yield rest, np.array(list(chain.from_iterable(each)), np.uint32), np.cumsum([len(i) for i in each])

    def ids(self, units: list) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([u[0] if type(u) is tuple else " " + u for u in units], add_special_tokens=False)]


class UnitCache:
    """A worker's cache of what units encode to: ids packed as numbers of ``kind``, or where kind is empty their count."""

    def __init__(self, units: ByteUnits, kept: int, kind: str = ""):
        self.units, self.cache, self.kind = units, Generations(kept), kind

    def known(self, needed: list[list]) -> dict:
        new, young = self.cache.missing(chain.from_iterable(needed)), self.cache.young
        for i in range(0, len(new), 8192):
            for units, ids, ends in self.units.encoded(new[i : i + 8192]):
                starts, stops = [0, *ends[:-1].tolist()], ends.tolist()
                if self.kind:
                    packed = ids.astype(self.kind)
                    width, data = packed.itemsize, packed.tobytes()
                    young.update((u, data[a * width : b * width]) for u, a, b in zip(units, starts, stops))
                else:
                    young.update((u, b - a) for u, a, b in zip(units, starts, stops))
        return young


@cache
def worker_units(path: str) -> ByteUnits:
    """The units of this worker process, for all its tasks."""
    return ByteUnits(path)


@cache
def worker_cache(path: str, kept: int, kind: str = "") -> UnitCache:
    """The cache of this worker process."""
    return UnitCache(worker_units(path), kept, kind)
