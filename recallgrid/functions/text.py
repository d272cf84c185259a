"""String expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script.

    ASCII separators go by translate(), so the pattern engine has only other scripts' ones to find.
    """
    spaced = F.translate(F.lower(text), _BREAKS, " " * len(_BREAKS))
    return F.array_remove(F.split(F.regexp_replace(spaced, r"[^\x00-\x7F\p{IsAlphabetic}\p{N}]+", " "), " "), "")


def snippet(text: Column, size: int = 160) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, size)


def chunks(text: Column, words: int = 900, tail: int = 20) -> Column:
    """Runs of ``words`` words; a last run of at most ``tail`` characters joins the one before."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    n = F.greatest(F.ceil(F.size(w) / words), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * words + 1, words), " "))
    last = F.element_at(parts, -1)
    short = (F.size(parts) > 1) & (F.char_length(last) <= tail)
    merged = F.concat(F.slice(parts, 1, F.size(parts) - 2), F.array(F.concat_ws(" ", F.get(parts, F.size(parts) - 2), last)))
    return F.when(short, merged).otherwise(parts)


def char_chunks(text: Column, size: int = 1500, overlap: int = 200, least: int = 60) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))), lambda x: F.char_length(F.trim(x)) >= least)


def org_id_ok(org: Column) -> Column:
    return org.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def glob_to_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or ("\\" + glob[i] if glob[i] in r"\.^$+{}[]()|" else glob[i])
            i += 1
    return f"^{out}$"


def allowed(path: Column, allow: list[str], deny: list[str]) -> Column:
    """Relative, without '..', in no denied glob and in an allowed one."""
    hit = lambda gs: F.lit(False) if not gs else path.rlike("|".join(map(glob_to_regex, gs)))
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~hit(deny) & hit(allow)
