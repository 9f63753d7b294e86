"""Token ids of whole texts, with the ids of parts that come again kept while a task runs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of a generation of a task's table, of which there are two, by the estimate of ``Kept.add``.
KEPT_BYTES = 48 << 20
#: The longest string that is kept, and how many strings are learned at once.
LONGEST, AT_ONCE = 1024, 1 << 15
_MARKS = ".,;:!?|%$#&*"
_PLAIN = re.compile(r"[!-~¡-ÿ]+")


class Kept:
    """Ids by string, in two generations: what a full one held and is asked for again moves to the new one."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def add(self, texts: list[str], ids: list[bytes]) -> None:
        """Holds more strings, none of which it holds; an entry counts as two objects with their heads and a place in a table."""
        self.now.update(zip(texts, ids, strict=True))
        self.held += 160 * len(texts) + sum(map(len, texts)) + sum(map(len, ids))

    def turn(self) -> None:
        """Starts a new generation if this one is full."""
        if self.held > KEPT_BYTES:
            self.now, self.before, self.held = {}, self.now, 0

    def lacking(self, asked: Iterable[str]) -> list[str]:
        """What isn't held; all else that is asked for is in ``now`` afterwards."""
        now, before = self.now, self.before
        new = [x for x in asked if x not in now]
        again = [x for x in new if x in before]
        self.add(again, [before[x] for x in again])
        return [x for x in new if x not in before]


class Encoder:
    """Encodes with a vocabulary file of the ``tokenizers`` library that drops white space and never joins what it separates.

    A text's ids are then those of its parts between ASCII white space, one after another. Parts of Latin-1 characters are cut
    further by ``pretoken``, the file's own rule for where tokens cannot reach across, after its lower-casing.
    """

    _made: dict[tuple[str, str], Encoder] = {}

    #: Fixed value: the pre-tokenizer pattern of the lower-casing word vocabulary.
    PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, pretoken: str = PRETOKEN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.cut_up = Tokenizer.from_file(path)  # for parts that are cut and lower-cased already
        self.cut_up.normalizer = normalizers.Sequence([])
        self.cut_up.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.whole.get_vocab(with_added_tokens=True)
        self.wide = "<u2" if max(names.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)  # tokens that end a word
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.cut = regex.compile(pretoken)
        self.kept = Kept()  # parts and the pieces they are cut into: a piece by itself is a part with the same ids

    @classmethod
    def of(cls, path: str, pretoken: str = PRETOKEN) -> Encoder:
        """The worker's one encoder for a file."""
        if (path, pretoken) not in cls._made:
            cls._made[path, pretoken] = cls(path, pretoken)
        return cls._made[path, pretoken]

    def forget(self) -> None:
        """Drops all that is kept: Python workers outlive tasks, and their next one may be another operator's."""
        self.kept = Kept()

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each of which is one word to the tokenizer."""
        out: list[bytes] = []
        groups = [pieces[i : i + 2000] for i in range(0, len(pieces), 2000)]
        for group, found in zip(groups, self.cut_up.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.wide)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(stops) != len(group):
                raise ValueError("a piece is not one word to the tokenizer")
            body, stops = ids.tobytes(), [0, *stops.tolist()]
            out += [body[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
        return out

    def _whole(self, part: str) -> bytes:
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, dtype=self.wide).tobytes()

    def _long(self, part: str) -> bytes:
        """A part that is too long to be kept, cut and encoded a few pieces at a time."""
        if "<|" in part or not _PLAIN.fullmatch(part):
            return self._whole(part)
        pieces, out = (m.group() for m in self.cut.finditer(part.lower())), bytearray()
        while some := list(islice(pieces, AT_ONCE)):
            out += b"".join(self._of_pieces(some))
        return bytes(out)

    def _learn(self, missing: list[str]) -> None:
        """Keeps the ids of parts, none of them long."""
        plain, cut = [], []
        for p in missing:
            if p.isascii() or _PLAIN.fullmatch(p):
                low = p.lower()
                if low.isalpha():
                    cut.append((low,))
                elif (word := low.rstrip(_MARKS)).isalpha():
                    cut.append((word, low[len(word) :]))
                elif "<|" not in p and _PLAIN.fullmatch(p):
                    cut.append(self.cut.findall(low))
                else:
                    continue
                plain.append(p)
        pieces = self.kept.lacking({x for c in cut for x in c})
        self.kept.add(pieces, self._of_pieces(pieces))
        now = self.kept.now
        get = now.__getitem__
        known = [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]
        new = {p: i for p, i in zip(plain, known, strict=True) if p not in now}
        if len(plain) < len(missing):
            new |= {p: self._whole(p) for p in missing if p not in now and p not in new}
        self.kept.add(list(new), list(new.values()))

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; the table turns between a few of them, so that one batch cannot outgrow it."""
        out: list[bytes] = []
        for i in range(0, len(parts), AT_ONCE):
            some = parts[i : i + AT_ONCE]
            self.kept.turn()
            if max(map(len, some)) <= LONGEST:
                self._learn(self.kept.lacking(some))
                out += map(self.kept.now.__getitem__, some)
            else:
                self._learn(self.kept.lacking([p for p in some if len(p) <= LONGEST]))
                out += [self.kept.now[p] if len(p) <= LONGEST else self._long(p) for p in some]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column; a null has none."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        found = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.array(list(map(len, found)), dtype=np.int32) // np.dtype(self.wide).itemsize
        which = words.indices.to_numpy()
        every = np.frombuffer(b"".join(map(found.__getitem__, which.tolist())), dtype=self.wide)
        reach = np.concatenate([[0], np.cumsum(sizes[which], dtype=np.int64)]) if len(which) else np.zeros(1, dtype=np.int64)
        edges = reach[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [every[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
