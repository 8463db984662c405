"""Words of whole texts for operators that fold case: runs of digits, letters and non-ASCII characters, with A-Z lowered."""

from __future__ import annotations

from collections.abc import Iterator

#: What each byte becomes: A-Z lower case; digits, a-z and bytes from 0x80 stay; all else is a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a piece, at least; a longer text is worked through in pieces.
PIECE = 1 << 22


def pieces(text: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[int, list[bytes], bool]]:
    """(number of the first word, words, whether it is the last) of a text's pieces, each beginning with the last `overlap` words before."""
    folded = text.translate(FOLD)
    at, first, held = 0, 0, []
    while True:
        end = folded.find(b" ", at + size)
        words = held + (folded[at:end] if end >= 0 else folded[at:]).split()
        yield first, words, end < 0
        if end < 0:
            return
        held = words[max(0, len(words) - overlap) :]
        first += len(words) - len(held)
        at = end


def rows_of(batch, column: str = "text", step: int = 64) -> Iterator[bytes]:
    """The texts of an Arrow batch in UTF-8, a null one empty, not all of them held at once."""
    import pyarrow as pa

    values = batch.column(column).cast(pa.binary())
    for at in range(0, batch.num_rows, step):
        yield from (t or b"" for t in values.slice(at, step).to_pylist())
