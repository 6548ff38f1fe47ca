"""Token ids of whole texts with a public tokenizer file, word by word with a bounded memory of words."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words remembered at once; two generations are held, so memory is bounded by about twice this.
REMEMBERED = 200_000
#: Bytes of text that are split and encoded together.
TOKEN_BYTES = 4 << 20
_TAIL = ".,;:!?#$%&*|"
_encoders: dict[str, WordTokenizer] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    """One encoder for each file and worker process, so that its words are remembered across tasks."""
    if path not in _encoders:
        _encoders[path] = WordTokenizer(path)
    _encoders[path].remembered = remembered
    return _encoders[path]


class WordTokenizer:
    """Ids of a tokenizer that drops white space and lower-cases, equal to encoding each whole text.

    Such a tokenizer's pieces never reach across white space, so a text's ids are the ids of its words in order; each
    distinct word is encoded once. A trailing run of signs after a letter is a piece of its own and encoded apart.
    Words of plain Latin letters skip the pre-tokenizer: they are one piece. Texts that hold "<|" may hold special
    tokens and are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # words are remembered here
        self.vocabulary = self._tokenizer.get_vocab_size()
        self.remembered = REMEMBERED
        if not self._drops_space():
            raise ValueError("this tokenizer keeps white space; encode whole texts instead")
        # how the normalizer and the pre-tokenizer write each plain letter; such letters do not change one another
        self._shown = {}
        for c in filter(str.isalpha, map(chr, range(0x250))):
            low = self._tokenizer.normalizer.normalize_str(c)
            if low.isalpha():
                self._shown[ord(c)] = "".join(x for x, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(low))
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _drops_space(self) -> bool:
        probe = self._tokenizer.encode_batch([" the\n\t of, A ", "the", "of,", "a"], add_special_tokens=False)
        return probe[0].ids == [i for x in probe[1:] for i in x.ids]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word without white space, as 32-bit values; remembered unless it is long."""
        ids = self._new.get(word) or self._old.get(word)
        if ids is None:
            stem = word.rstrip(_TAIL)
            if len(stem) < len(word) and stem[-1:].isalpha():
                ids = self.word(stem) + self.word(word[len(stem):])
            elif word.isalpha() and max(word) < "ɐ" and "İ" not in word:
                ids = array("I", [t.id for t in self._model.tokenize(word.translate(self._shown))]).tobytes()
            else:
                ids = self._whole(word)
        if len(word) <= 64:
            if len(self._new) >= self.remembered:
                self._old, self._new = self._new, {}
            self._new[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the n + 1 places where the texts begin; null is empty."""
        texts = pc.fill_null(texts, "")
        special = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|")))
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = np.asarray(words.offsets, dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = list(map(self._new.get, distinct))
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self.word(distinct[i]) if distinct[i] else b""
        lengths = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        codes = np.asarray(coded.indices, dtype=np.int64)
        takes = lengths[codes]
        done = np.zeros(len(takes) + 1, dtype=np.int64)
        np.cumsum(takes, out=done[1:])
        first = (np.cumsum(lengths) - lengths)[codes]
        out = flat[np.repeat(first - done[:-1], takes) + np.arange(done[-1])]
        offsets = done[ends - ends[0]]
        if not len(special):
            return out, offsets
        parts = [out[offsets[i]:offsets[i + 1]] for i in range(len(texts))]
        for i in special.tolist():
            parts[i] = np.frombuffer(self._whole(texts[i].as_py()), dtype=np.uint32)
        offsets = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        return np.concatenate(parts), offsets
