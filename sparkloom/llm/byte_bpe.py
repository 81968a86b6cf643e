"""Ids of a public byte-level BPE vocabulary, from its `tokenizers` JSON file, by the faster engine for it.

The file's vocabulary and merges are given to `tiktoken` when each merge's id follows the one before, as
then both libraries apply the same merges in the same order; otherwise `tokenizers` itself is used.

The pattern that splits words looks ahead behind whitespace, which takes stack for each character of a run. Runs
over `RUN` are therefore split off here by the same rule (all of a run but its last character, or the whole run
where the text or a special token follows at once) and merged as one piece, whatever their length.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The pre-tokenizer of this family of vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 20
#: Unicode's White_Space characters (fixed value), as the pattern's \s takes them.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 1000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LONG = re.compile(f"[{SPACE}]{{{RUN},}}")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its list of ids, without special tokens added; cached in each worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ordered = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
    shape = spec["pre_tokenizer"] or {}
    if ordered and shape.get("type") == "ByteLevel" and shape.get("use_regex", True) and not shape.get("add_prefix_space") and not spec["normalizer"]:
        import tiktoken

        byte = byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return functools.partial(_encode, coder, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)"))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def _encode(coder, special: re.Pattern, text: str) -> list[int]:
    """The ids of a text, with long runs of whitespace taken out of the pattern's hands."""
    whole = functools.partial(coder.encode, allowed_special="all", disallowed_special=())
    if not _LONG.search(text):
        return whole(text)
    ids: list[int] = []
    for part in re.split(f"({special.pattern})", text):
        if special.fullmatch(part):
            ids += whole(part)
            continue
        at = 0
        for run in _LONG.finditer(part):
            stop = run.end() if run.end() == len(part) else run.end() - 1
            ids += whole(part[at : run.start()])
            ids += coder._encode_single_piece(part[run.start() : stop])
            at = stop
        ids += whole(part[at:])
    return ids


def _cuts(text: str):
    """Parts of at most about CHUNK characters, cut before a single space between two other characters."""
    at = 0
    while len(text) - at > CHUNK:
        stop = text.find(" ", at + CHUNK)
        while 0 < stop < len(text) - 1 and (text[stop - 1].isspace() or text[stop + 1].isspace()):
            stop = text.find(" ", stop + 1)
        if not 0 < stop < len(text) - 1:
            break
        yield text[at:stop]
        at = stop
    yield text[at:]


def ids(path: str, text: str) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit numbers."""
    encode = encoder(path)
    if len(text) <= CHUNK:
        return np.array(encode(text), dtype="<u4")
    return np.concatenate([np.array(encode(part), dtype="<u4") for part in _cuts(text)])
