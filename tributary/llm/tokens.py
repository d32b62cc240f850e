"""Token ids of whole texts by a public tokenizer, word by word with a cache."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Lower-cased texts of these characters are cut into runs of letters, single digits and runs of marks.
_PLAIN = re.compile(r"[\x09-\x0d\x20-&(-~ßà-öø-ÿ]*")
_PARTS = re.compile(r"[a-zßà-öø-ÿ]+|[0-9]|[^\sa-zßà-öø-ÿ0-9]+")
#: What a tokenizer must say of itself for that cut to be its own.
_FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def cuts_parts(described: str) -> bool:
    """Whether a tokenizer (its JSON text) encodes the parts of a plain text one by one.

    True if it folds case, cuts exactly into letters, single digits and marks,
    drops the rest, joins nothing over such cuts, and all its added tokens begin
    with ``<|``. Plain texts hold no apostrophe, the only other thing it cuts at.
    """
    d = json.loads(described)
    normalizer, pre, model = (d.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    return (
        normalizer.get("normalizers") == _FOLDS
        and pre.get("pretokenizers") == _SPLITS
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in d.get("added_tokens", ()))
    )


class Encoder:
    """Encodes texts with a tokenizers file that drops white space.

    Such a tokenizer never joins ids over ASCII white space, so a text's ids are
    those of its words in a row, and each distinct word is encoded by the library
    once while the cache holds it. Where the tokenizer's own description shows that
    it ignores case and cuts between letters, digits and marks (cuts_parts), texts of
    plain characters without an apostrophe are cut there too, as there are fewer
    such parts than words. add_special_tokens is off. A null text is empty.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.by_parts, self.limit = cuts_parts(self.tokenizer.to_str()), limit
        self.ids: dict[str, bytes] = {}

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _batch(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space, encoded as one text and cut by offsets."""
        if not words:
            return []
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        starts = np.zeros(len(words), np.int64)
        np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
        cuts = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), starts).tolist()
        raw = ids.tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip(cuts, [*cuts[1:], len(ids)])]

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.by_parts and "<|" not in text and _PLAIN.fullmatch(low := text.lower()):
            return _PARTS.findall(low)
        return [w.decode("utf-8") for w in text.encode("utf-8", "replace").split()]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        split = [self._split(t) for t in texts]
        if len(self.ids) > self.limit:
            self.ids.clear()
        new = list(set().union(*split).difference(self.ids))
        for at in range(0, len(new), 8192):
            self.ids.update(zip(new[at : at + 8192], self._batch(new[at : at + 8192])))
        get = self.ids.__getitem__
        return [b"".join(map(get, s)) + self.end for s in split]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = END_ID) -> Encoder:
    """This process's encoder for a file."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
