"""What the byte-level BPE files of the tokenizers library have in common."""

from __future__ import annotations

import os


def load(path: str):
    """The tokenizer without truncation or padding, with one thread, as Spark runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: visible Latin-1 characters for themselves, the rest from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


def as_bytes_text(text: str, letters: dict[int, str]) -> str:
    """The text as the model sees it, one character for each byte."""
    if text.isascii() and text.isprintable() and " " not in text:
        return text
    return text.encode().decode("latin-1").translate(letters)


def special_strings(tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]
