"""Parts of a text that byte-level BPE encodes one by one, found with str.split where that is exact."""

from __future__ import annotations

from .shared import has_adjacent_space


def units(text: str) -> list[list[str]] | None:
    """Lines, each split at spaces, or None where that is not exact.

    If no two white-space characters adjoin, the splitting pattern of byte-level BPE ends a part before each space and
    around each line feed, so the text is the concatenation of: each line's first piece; a space and the piece, for the
    others; a line feed between lines; and each of these encodes by itself.
    """
    if has_adjacent_space(text):
        return None
    return [line.split(" ") for line in text.split("\n")]


class Cache(dict):
    """A dict from units to encodings that, when it holds too many, keeps those that are needed now; what it holds never
    changes a result."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self, needed: set[str]) -> None:
        if len(self) + len(needed) > self.most:
            kept = [(x, self[x]) for x in needed if x in self]
            self.clear()
            self.update(kept)


def encode_texts(texts: list[str], heads: Cache, tails: Cache, encode_new, encode_whole) -> list[bytes]:
    """Encodings of the texts, as bytes.

    ``heads`` maps pieces, ``tails`` maps pieces with a space before them. ``encode_new`` encodes a list of distinct
    units; ``encode_whole`` a list of texts that ``units`` can't split.
    """
    split = [units(t) for t in texts]
    new_heads, new_tails = {"\n"}, set()
    for lines in split:
        for pieces in lines or ():
            new_heads.add(pieces[0])
            new_tails.update(pieces[1:])
    heads.room(new_heads)
    tails.room(new_tails)
    todo = [x for x in new_heads if x not in heads]
    heads.update(zip(todo, encode_new(todo)))
    todo = [x for x in new_tails if x not in tails]
    tails.update(zip(todo, encode_new([" " + x for x in todo])))
    whole = iter(encode_whole([t for t, lines in zip(texts, split) if lines is None]))
    feed, head, tail = heads["\n"], heads.__getitem__, tails.__getitem__
    out = []
    for lines in split:
        if lines is None:
            out.append(next(whole))
        else:
            out.append(feed.join([head(p[0]) + b"".join(map(tail, p[1:])) for p in lines]))
    return out

