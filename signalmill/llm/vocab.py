"""Public tokenizer vocabularies on the executors. Nothing here trains or copies a tokenizer."""

from __future__ import annotations

import sys
import types

#: The pre-tokenisation pattern of byte-level BPE (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kept(key, build):
    """``build()`` once per Python worker, also over several tasks."""
    store = sys.modules.setdefault("_signalmill_kept", types.ModuleType("_signalmill_kept")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def byte_pieces(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE file, whose letters stand for bytes; special tokens left out."""
    import json

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}


def byte_encoder(path: str):
    """text -> uint32 ids, the same as the file's own tokenizer gives without adding special tokens.

    The file's merges are in the order of the ids they make, so its vocabulary works as ranks in the
    faster library.
    """

    def build():
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        ranks = {piece: i for piece, i in byte_pieces(path).items() if i not in special.values()}
        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)

    encoding, special = kept(("byte_encoder", path), build)

    def encode(text: str):
        if any(s in text for s in special):
            return encoding.encode_to_numpy(text, allowed_special="all")
        return encoding.encode_to_numpy(text, disallowed_special=())

    return encode
