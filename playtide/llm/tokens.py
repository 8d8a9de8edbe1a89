"""Encoding with the tokenizers library, each distinct run of characters once a worker.

The ids are those of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`; with
special=False, those of the same call under `encode_special_tokens`, which reads the contents of
special tokens as plain text.

A text is cut before a space that a non-blank character follows.  No token of the two kinds of
tokenizer named in `cuts()` spans such a cut (their patterns match white space at the start of a
token only), so the ids of a text are those of its pieces, one after another.  Pieces of Latin
text without apostrophes are cut further, between letters, digits and the rest, where those
patterns end a token too.  What is left recurs a lot: each distinct run is given to the library
once and then looked up, in tables of bounded size that a worker keeps from task to task.

With special=True, texts that hold an added token's content (`<|endoftext|>` and the like) are
encoded whole.  So is every text under a tokenizer of any other kind.
"""

from __future__ import annotations

import json
import os
import re
import threading

import numpy as np

from playtide.llm.common import give_back, ragged_take

_CUT = re.compile(r" (?=\S)")
#: Pieces that may be cut further: below U+0250 composed forms are stable; single line ends only.
_LATIN = re.compile("[!-&(-~\xa1-ɏ]+(?:\n[!-&(-~\xa1-ɏ]+)*\n?")
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_DOUBLE = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
#: White space to Python alone.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]+|[^{_LETTERS}{_DIGITS}]+")


#: The pattern and normalizers of the lower-casing word tokenizer that cuts() knows.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def cuts(spec: dict) -> str:
    """How texts may be cut under a tokenizer file: "space", "fold" (lower-cased, white space dropped) or "whole"."""
    model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and not spec.get("truncation") and not spec.get("padding")
    # other added tokens may match across cuts, or where a run was lower-cased
    plain = plain and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in spec.get("added_tokens", []))
    if plain and norm is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not model.get("end_of_word_suffix"):
        return "space"
    if plain and norm and norm.get("normalizers") == _WORD_NORMALIZERS and pre.get("type") == "Sequence" and len(pre["pretokenizers"]) == 2:
        split, level = pre["pretokenizers"]
        if split.get("pattern") == {"Regex": _WORD_PATTERN} and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]:
            return "fold"
    return "whole"


class _Numbers(dict):
    """Numbers strings as they are first met, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Lists:
    """Growing lists of numbers, one after another in one array."""

    def __init__(self):
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.counts = np.zeros(1 << 14, dtype=np.int32)
        self.used = self.rows = 0

    def add(self, flat: list[int], counts: list[int]) -> None:
        n = np.array(counts, dtype=np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.rows + len(n) > len(self.starts):
            self.starts, self.counts = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.counts))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.rows : self.rows + len(n)] = self.used + np.cumsum(n) - n
        self.counts[self.rows : self.rows + len(n)] = n
        self.used += len(flat)
        self.rows += len(n)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[rows].astype(np.int64)
        return self.flat[ragged_take(self.starts[rows], n)], n


class PieceEncoder:
    """Ids of whole texts, under any tokenizer file.  fold: None, or whether the tokenizer lower-cases and drops white space."""

    _kept: dict = {}
    _idle: threading.Timer | None = None
    _busy = False
    _lock = threading.Lock()

    def __init__(self, path: str, fold: bool | None = None, pieces: int = 400_000, runs: int = 1_000_000, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = cuts(spec)
        if fold is not None and fold != (self.cut == "fold"):
            raise ValueError(f"{path} is no such tokenizer")
        self.path, self.special, self.whole = path, special, None
        self.added = [t["content"] for t in spec.get("added_tokens", [])] if special else []
        self.fold, self.limits = self.cut == "fold", (pieces, runs)
        # for runs: a run that reads like an added token only once it is lower-cased is none
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self._forget_pieces()
        self._forget_runs()

    @classmethod
    def shared(cls, path: str) -> PieceEncoder:
        """The encoder of this worker process."""
        with cls._lock:
            cls._busy = True
        if cls._idle is not None:
            cls._idle.cancel()
        found = cls._kept.get(path)
        if found is None:
            cls._kept.clear()
            found = cls._kept[path] = cls(path, special=True)
        return found

    @classmethod
    def rest(cls, seconds: float = 20.0) -> None:
        """A task is done: its tables are given back unless another task of this worker asks for them soon."""
        if cls._idle is not None:
            cls._idle.cancel()

        def free() -> None:
            with cls._lock:
                if cls._busy:
                    return
                for encoder in cls._kept.values():
                    encoder._forget_pieces()
                    encoder._forget_runs()
            give_back()

        cls._busy = False
        cls._idle = threading.Timer(seconds, free)
        cls._idle.daemon = True
        cls._idle.start()

    def _whole(self, text: str) -> list[int]:
        if self.whole is None:
            self.whole = type(self.tokenizer).from_file(self.path)
            self.whole.encode_special_tokens = not self.special
        return self.whole.encode(text, add_special_tokens=False).ids

    def _forget_pieces(self) -> None:
        self.pieces, self.runs_of, self.row = _Numbers(), _Lists(), np.zeros(0, dtype=np.int64)

    def _forget_runs(self) -> None:
        self.runs, self.ids_of = _Numbers(), _Lists()

    def _pieces(self, text: str) -> list[str]:
        if self.fold and not _SEPARATORS.search(text):  # every white space ends a token and is dropped
            return (text.lower() if text.isascii() else text).split()
        plain = text.isascii() and text[-1] != " " and not any(x in text for x in _DOUBLE) and not _SEPARATORS.search(text)
        pieces = text.split(" ") if plain else _CUT.split(text)  # alike where a letter follows every space
        if pieces[0]:
            pieces[0] = "\n" + pieces[0]
        else:
            del pieces[0]
        return pieces

    def _cut_runs(self, key: str) -> list[str]:
        """A piece's runs.  A key that starts with a line end is a text's beginning; others follow a space."""
        first = key[0] == "\n"
        text = key[1:] if first else key
        if not _LATIN.fullmatch(text):
            return [text if first else " " + text]
        if self.fold:
            text = text.lower()
            return [text] if text.isalpha() else _RUNS.findall(text)
        runs = [text] if text.isalpha() else _RUNS.findall(text)
        if not first:
            runs[0] = " " + runs[0]
        return runs

    def _learn(self) -> None:
        number, new = self.runs.__getitem__, self.pieces.new
        # most are one run, or one and a mark
        least = "\x80" if self.fold else "ɐ"
        whole = [i for i, k in enumerate(new) if k.isalpha() and max(k) < least]
        one = np.zeros(len(new), dtype=bool)
        one[whole] = True
        rest = np.flatnonzero(~one).tolist()
        flat = list(map(number, [new[i].lower() for i in whole] if self.fold else [" " + new[i] for i in whole]))
        runs: list[str] = []
        counts = []
        lead = "" if self.fold else " "
        for key in map(new.__getitem__, rest):
            word, mark = key[:-1], key[-1]
            if mark in ".,;:?!" and word.isalpha() and max(word) < least:
                runs += (lead + (word.lower() if self.fold else word), mark)
                counts.append(2)
            else:
                found = self._cut_runs(key)
                runs += found
                counts.append(len(found))
        row = np.empty(len(new), dtype=np.int64)
        row[whole] = np.arange(len(whole))
        row[rest] = np.arange(len(whole), len(new))
        self.row = np.concatenate((self.row, row + self.runs_of.rows))
        self.runs_of.add(flat + list(map(number, runs)), [1] * len(whole) + counts)
        self.pieces.new = []
        new = self.runs.new
        for i in range(0, len(new), 10_000):
            found = self._ids_of_runs(new[i : i + 10_000])
            self.ids_of.add([t for f in found for t in f], list(map(len, found)))
        self.runs.new = []

    def _ids_of_runs(self, runs: list[str]) -> list[list[int]]:
        """The library's ids of each run.

        A run of ASCII letters, in lower case where the tokenizer folds, is left alone by its normalizers and
        not split by its patterns, so the library's BPE model is given it at once; a space before it is what
        the byte-level step has for one.  Other runs go through the whole tokenizer.
        """
        tokenize, space = self.model.tokenize, None if self.fold else " "
        found: list = [None] * len(runs)
        others = []
        for i, run in enumerate(runs):
            spaced = run[0] == space
            if run.isascii() and (run[1:] if spaced else run).isalpha() and (not self.fold or run.islower()):
                found[i] = [t.id for t in tokenize("\u0120" + run[1:] if spaced else run)]
            else:
                others.append(i)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([runs[i] for i in others], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by `end`, and how many each text has."""
        if len(self.runs) > self.limits[1]:
            self._forget_runs()
            self._forget_pieces()
        elif len(self.pieces) > self.limits[0]:
            self._forget_pieces()
        number = self.pieces.__getitem__
        parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
        whole: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            if self.cut == "whole" or any(x in t for x in self.added):
                whole[i] = self._whole(t)
            elif t:
                pieces = self._pieces(t)
                sizes[i] = len(pieces)
                parts.append(np.fromiter(map(number, pieces), dtype=np.int32, count=len(pieces)))
        self._learn()
        runs, n = self.runs_of.take(self.row[np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)])
        ids, m = self.ids_of.take(runs)
        per_piece = np.concatenate(([0], np.cumsum(n)))
        per_run = np.concatenate(([0], np.cumsum(m)))
        stops = np.cumsum(sizes)
        ends = per_run[per_piece[stops]]
        per = ends - per_run[per_piece[stops - sizes]]
        if whole:
            ids = np.concatenate([whole[i] if i in whole else ids[e - k : e] for i, (e, k) in enumerate(zip(ends.tolist(), per.tolist(), strict=True))]).astype(np.int32)
            per[list(whole)] = [len(x) for x in whole.values()]
        out = np.empty(len(ids) + len(texts), dtype=np.int32)
        closed = np.cumsum(per + 1) - 1
        inside = np.ones(len(out), dtype=bool)
        inside[closed] = False
        out[inside] = ids
        out[closed] = end
        return out, per + 1
