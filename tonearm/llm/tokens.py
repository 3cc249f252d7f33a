"""Token ids of whole texts, by the vocabularies of public tokenizer files."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from functools import lru_cache


@lru_cache(maxsize=4)
def tiktoken_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed value: how a byte-level pre-tokenizer splits text unless told otherwise.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranked_encoding(path: str):
    """The tokenizer of a JSON file as a rank encoding, which gives the same ids of ordinary text in a third of the time;
    None where the file asks for more than byte-level pairs whose ids are in the order of their merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(
        (whole.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("byte_fallback"), model.get("ignore_merges"))
    )
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in whole.get("added_tokens", ())}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(ranks) != len(merged) + 256:
        return None
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return array("I", ids).tobytes()


@lru_cache(maxsize=4)
def json_encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to the ids that the tokenizers library gives it with ``add_special_tokens=False``.

    Added tokens (special ones too) that stand in a text are single ids there, as the library has it: such texts go
    through the library itself.
    """
    ranked, tokenizer = ranked_encoding(path), json_tokenizer(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if ranked is None or any(a in text for a in added):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return ranked.encode_ordinary(text)

    return encode
