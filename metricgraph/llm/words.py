"""Words of whole texts: runs of digits, letters a-z (A-Z lower-cased, nothing else) and characters beyond ASCII."""

from __future__ import annotations

#: What becomes of each byte of UTF-8: A-Z in lower case, digits, a-z and bytes beyond ASCII as they are, a blank otherwise.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text in order, as UTF-8; none for null."""
    return text.encode().translate(_FOLDED).split() if text else []
