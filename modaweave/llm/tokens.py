"""Token ids of whole texts, by public vocabularies.

Two kinds of BPE vocabulary run on a faster merge engine than the library that defines them, with the
same ids: byte-level ones, and lower-casing ones whose words end in ``</w>``.  A file of another make,
and texts outside the range in which both engines were compared, go to the library itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Splitting patterns of the two kinds, as the vocabularies' files or their library state them.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The sign that stands for a space in piece vocabularies.
SPACE = "\u2581"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The merge engine is quadratic in one piece.  A text with a block of this many characters that has no
#: space, or nothing else, goes to the library.
LONG_RUN = 1500


def long_run(text: str) -> bool:
    for k in range(0, len(text) - LONG_RUN + 1, LONG_RUN):
        block = text[k : k + LONG_RUN]
        words = block.split(None, 1)
        if not words or len(words[0]) == LONG_RUN:
            return True
    return False


#: Letters, marks and signs of long standing, on whose classes and cases all engines agree.
_unusual = re.compile("[^\x01-\x1b\x20-ԯ -⁯ぁ-ゖ一-龥가-힣]").search


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, turned round."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _spec(path: str) -> tuple[dict, dict[str, int], list[str], dict[str, int]]:
    """(file, vocabulary, merged strings in order, special strings)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"].get("merges", [])]
    return spec, spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def _library(path: str, plain_specials: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain_specials
    return tok


class ByteBpe:
    """Ids of byte-level BPE.  ``plain_specials``: strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False):
        import tiktoken

        spec, vocab, merges, special = _spec(path)
        back = byte_of_char()
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in special}
        self.tok = _library(path, plain_specials)
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        same = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if same and all(vocab[m] == 256 + k for k, m in enumerate(merges)) and len(set(self.bytes_of.values())) == len(self.bytes_of):
            self.fast = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens=special)
        self._allowed = set() if plain_specials else set(special)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or long_run(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        if self._allowed:
            return self.fast.encode(text, allowed_special=self._allowed, disallowed_special=())
        return self.fast.encode_ordinary(text)


class _Cuts(dict):
    """Words with signs or digits to their pieces, a zero byte between them; forgotten when many."""

    def __init__(self, pieces, most: int = 200_000):
        self.pieces, self.most = pieces, most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = "\0".join(self.pieces(word))
        return out


class WordBpe:
    """Ids of lower-casing BPE with word ends; white space gives no ids.

    The engine sees each piece with a zero byte behind it, which stands for the word end.  A zero byte
    of its own marks the end of a text.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        spec, vocab, merges, special = _spec(path)
        self.tok = _library(path, False)
        self.special = list(special)
        self.fast = None
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or splits != [WORD_PATTERN, None] or spec["model"].get("end_of_word_suffix") != "</w>":
            return
        back = byte_of_char()
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        singles = [t for t in vocab if len(t) == 1]
        ends = [t for t in vocab if len(t) == 5 and t.endswith("</w>")]
        for t in [*singles, *ends, *merges]:
            end = t.endswith("</w>")
            ranks[bytes(back[c] for c in (t[:-4] if end else t)) + (b"\0" if end else b"")] = len(ids)
            ids.append(vocab[t])
        if len(ranks) == len(ids) and len(singles) == len(ends) == 256:
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
            self.end, self.map = ranks[b"\0"], np.array(ids, dtype="<u4")
            self.cuts = _Cuts(regex.compile(WORD_PATTERN).findall)

    def _words(self, text: str) -> list[str] | None:
        """Words of a text, null where the library itself has to encode it.  A run of letters is one
        piece; other words are cut by the pattern."""
        if _unusual(text) or any(s in text for s in self.special):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if long_run(text):
            return None
        words = text.lower().split()
        cuts = self.cuts
        return [w if w.isalpha() else cuts[w] for w in words]

    def of(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by ``end``; offsets of the texts).  Null is empty."""
        n = len(texts)
        alone: dict[int, np.ndarray] = {}
        parts: list[str] = []
        for k, t in enumerate(texts):
            words = self._words(t) if t and self.fast is not None else None
            if words is not None:
                parts += words
            elif t:
                alone[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4")
            parts.append("")
        if self.fast is None:
            ids, marks = np.full(n, end, dtype="<u4"), np.arange(n)
        else:
            raw = np.array(self.fast.encode_ordinary("\0".join([*parts, ""])) if n else [], dtype=np.int64)
            ids, marks = self.map[raw], np.flatnonzero(raw == self.end)
            ids[marks] = end
        if alone:
            at = np.array(sorted(alone))
            ids = np.insert(ids, np.repeat(marks[at], [len(alone[k]) for k in at]), np.concatenate([alone[k] for k in at]))
            marks = marks + np.cumsum(np.bincount(at, weights=[len(alone[k]) for k in at], minlength=n)).astype(np.int64)
        return ids, np.r_[0, marks + 1]


class PieceBpe:
    """Ids and bytes of a piece vocabulary with byte fallback; it puts a space before the text itself.

    Pieces never span a space that follows something else, so a text is merged word by word.  Characters
    are put together from bytes before any merge; what stays unfinished is spelt in byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        every = range(m.get_piece_size())
        pieces = {i: m.id_to_piece(i) for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in every if m.is_byte(i)}
        self.bytes_of = {i: bytes([b]) for b, i in byte_ids.items()} | {i: p.replace(SPACE, " ").encode() for i, p in pieces.items()}
        self.fast = None
        ordered = sorted(pieces, key=lambda i: (-m.get_score(i), i))
        longer = [i for i in ordered if len(pieces[i]) > 1]
        scores = [m.get_score(i) for i in longer if pieces[i].strip(SPACE)]
        spans = any(SPACE in p.lstrip(SPACE) for p in pieces.values())
        if len(byte_ids) < 256 or spans or len(set(scores)) < len(scores) or any(m.is_unused(i) for i in every) or b"identity" not in m.serialized_model_proto():
            return
        ranks = {bytes([b]): b for b in range(256)}
        spelt = [[byte_ids[b]] for b in range(256)]

        def add(raw: bytes, ids: list[int]) -> None:
            if raw in ranks:
                spelt[ranks[raw]] = ids
            else:
                ranks[raw] = len(spelt)
                spelt.append(ids)

        single = {self.bytes_of[i]: i for i in pieces if len(pieces[i]) == 1}
        for raw in sorted(single, key=len):
            for k in range(2, len(raw)):
                if raw[:k] not in ranks:
                    add(raw[:k], [byte_ids[b] for b in raw[:k]])
        for raw, i in single.items():
            add(raw, [i])
        for i in longer:
            add(self.bytes_of[i], [i])
        self.size = np.array([len(x) for x in spelt])
        self.flat = np.array([i for x in spelt for i in x], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.fast = tiktoken.Encoding("pieces", pat_str=r" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Runs of spaces, whose pieces tie in rank, go to the library."""
        if self.fast is None or SPACE in text or "  " in text or text[:1] == " " or long_run(text):
            return np.array(self.model.encode(text), dtype=np.int64)
        ranks = np.array(self.fast.encode_ordinary(" " + text), dtype=np.int64) if text else np.zeros(0, dtype=np.int64)
        size = self.size[ranks]
        ids = self.flat[self.at[ranks]]
        if (size == 1).all():
            return ids
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ranks] - (ends - size), size) + np.arange(ends[-1])]


#: Bytes of text that a worker turns into ids at a time.
SLICE = 64 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``SLICE`` bytes of text, so that ids never fill an Arrow array."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // SLICE
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(sizes)].tolist()
    return ((lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo)


_loaded: dict[tuple, object] = {}


def byte_bpe(path: str, plain_specials: bool = False) -> ByteBpe:
    """One per Python worker."""
    key = (path, plain_specials)
    if key not in _loaded:
        _loaded[key] = ByteBpe(path, plain_specials)
    return _loaded[key]


def piece_bpe(path: str) -> PieceBpe:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
