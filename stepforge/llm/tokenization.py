"""Token ids by a public tokenizer file, encoding each distinct word once while it stays in a task's cache."""

import os
import re

from itertools import islice

import numpy as np

#: Letters and numbers of Latin-1 in lower case; other texts are encoded whole by the tokenizer itself.
_L = "a-z" + "".join(map(chr, (0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100))))
_N = "0-9" + "".join(map(chr, (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)))
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: Characters that regular expression engines may or may not take for white space.
_DOUBTFUL = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0))) + "]")
CACHE = 300_000


class ChunkTokenizer:
    """Exact for a tokenizer whose normaliser is NFC and lower case and whose pre-tokenizer is _WORD (checked by tests
    against encoding whole texts); within Latin-1 neither NFC nor lower case looks beyond one character."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self._tok = path, None
        self.cache: dict[str, bytes] = {}
        # the same model for words that are already normalised and parted by spaces
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids that end a word, for tokenizers that mark word ends.
        suffix = getattr(self.words.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.words.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for w, i in self.words.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True

    @property
    def tok(self):
        """The tokenizer as it is, loaded when a text needs it."""
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_file(self.path)
            self._tok.encode_special_tokens = True
        return self._tok

    def encode(self, text: str) -> bytes:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(text)
        if _DOUBTFUL.search(text):
            return self._whole(text)
        words = _WORD.findall(text.lower())
        cache = self.cache
        missing = list(set(words).difference(cache))
        if missing:
            if len(cache) + len(missing) > CACHE:  # drop the older half; the frequent ones come back
                for w in list(islice(cache, len(cache) // 2)):
                    del cache[w]
                missing = list(set(words).difference(cache))
            cache.update(zip(missing, self._words(missing), strict=True))
        return b"".join(map(cache.__getitem__, words))

    def _words(self, words: list[str]) -> list[bytes]:
        """Each word's ids: all are encoded as one text and parted at the ids that end words."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        data = ids.tobytes()
        ends = (cuts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer and cache for each path and worker process: later tasks of the worker find their words."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]
