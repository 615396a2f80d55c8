"""Text functions with the source's null behavior."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def left_chars(s, n: int) -> Column:
    """``left(s, n)``."""
    return F.substring(_c(s), 1, n)


def concat_strict(*parts) -> Column:
    """``a || b`` and text ``a + b``: null if any part is null.

    Non-string parts are cast to string (``'dms' || maintid::varchar``).
    ``concat_ws`` would skip nulls, which is not the source's rule.
    """
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.concat(*cols)


def drop_first_char(s) -> Column:
    """The text from its second character on, however long."""
    text = _c(s)
    return F.substr(text, F.lit(2), F.char_length(text))


def split_part(s, sep: str, n: int) -> Column:
    """``split_part``; past the end gives ``''``."""
    return F.split_part(_c(s), F.lit(sep), F.lit(n))


def char_in(needle: str, s) -> Column:
    """``charindex(needle, s) > 0`` (case-sensitive)."""
    return F.locate(needle, _c(s)) > 0


def like_contains(text, name) -> Column:
    """``text like '%' || name || '%'``; ``_``/``%`` in name stay wildcards."""
    return F.like(_c(text), F.concat(F.lit("%"), _c(name), F.lit("%")))


# Access-list privilege letters and the privilege each grants,
# in the order the source tests them.
ACL_LETTERS: dict[str, str] = {
    "r": "select",
    "w": "update",
    "a": "insert",
    "d": "delete",
    "R": "rule",
    "x": "references",
    "t": "trigger",
    "X": "execute",
    "U": "usage",
    "C": "create",
    "T": "temporary",
}


def decode_access(acl_text, grantee, letters: Mapping[str, str] = ACL_LETTERS) -> Column:
    """Privilege list of ``grantee`` in a ``|``-joined access list.

    Takes the text after the first occurrence of the grantee name, up to the
    next ``/`` (``split_part(split_part(acl, name, 2), '/', 1)``), tests each
    letter, and joins the privilege names with ``,`` -- a native expression
    built from the letter table, no UDF. Q7 is kept: a name that is part of a
    longer name matches inside it.
    """
    acl_text, grantee = _c(acl_text), _c(grantee)
    flags = F.split_part(F.split_part(acl_text, grantee, F.lit(2)), F.lit("/"), F.lit(1))
    pieces = [F.when(F.locate(letter, flags) > 0, F.lit(f",{name} ")).otherwise(F.lit(""))
              for letter, name in letters.items()]
    return drop_first_char(F.concat(*pieces))
