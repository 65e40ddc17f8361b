"""Byte-level BPE of whole texts from a public rank file."""

from __future__ import annotations

import base64
import re

import numpy as np

END_OF_TEXT = "<|endoftext|>"
#: White space as split patterns know it, in runs so long that the pattern's look ahead could not step back over them.
_LONG = 100_000
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(f"(?<!{_SPACE}){_SPACE}{{{_LONG},}}")  # tried where a run begins only, so one that is too short costs its length once


class RankTokenizer:
    """Ids by a rank file (lines of ``token-in-base64 rank``) and its split pattern.

    The string ``END_OF_TEXT`` in a text is one id, the one after the last rank,
    and parts the text around it.  Any text is encoded whole; the empty text has
    no ids.  A run of ``_LONG`` or more white-space characters never meets the
    pattern, which would give it as one piece, but for its last character where
    other text follows: that piece goes to the byte pairs at once.
    """

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: max(ranks.values()) + 1})
        self.byte_lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in [*ranks.items(), (END_OF_TEXT.encode(), max(ranks.values()) + 1)]:
            self.byte_lengths[rank] = len(token)

    def broken(self) -> np.ndarray:
        """For every id, whether its bytes are not whole characters."""
        valid = (self._bpe.decode_single_token_bytes(i).decode(errors="ignore").encode() for i in range(len(self.byte_lengths)))
        return np.fromiter(map(len, valid), np.int64, len(self.byte_lengths)) != self.byte_lengths

    def tokens(self, text: str) -> list[int]:
        if len(text) < _LONG or not _RUN.search(text):
            return self._bpe.encode(text, allowed_special={END_OF_TEXT}) if END_OF_TEXT in text else self._bpe.encode_ordinary(text)
        ids: list[int] = []
        for i, part in enumerate(text.split(END_OF_TEXT)):
            if i:
                ids.append(len(self.byte_lengths) - 1)
            at = 0
            for run in _RUN.finditer(part):
                end = run.end() - (run.end() < len(part))
                ids += self._bpe.encode_ordinary(part[at : run.start()])
                ids += self._bpe._core_bpe.encode_single_piece(part[run.start() : end].encode())
                at = end
            ids += self._bpe.encode_ordinary(part[at:])
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokens(text), "<u4")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a public rank file that is installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
