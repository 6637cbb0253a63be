"""URL expressions: the safe template of an address, its host, and whether a navigation stays on the site."""

from __future__ import annotations

from maskwright.functions import patterns as P
from maskwright.functions.sql import fresh, let, lit

# scheme, authority, path, query of an address on the web; scheme and rest of any other.
_WEB = r"^(?i:(https?|ftp|wss?))://(?:[^/?#\\@]*@)?([^/?#\\@\s]+)([^?#]*)(\?[^#]*)?"
_OTHER = r"^([A-Za-z][A-Za-z0-9+.-]*):([^?#]*)(\?[^#]*)?"


def _part(url: str, pattern: str, group: int) -> str:
    return f"regexp_extract({url}, {lit(pattern)}, {group})"


def _authority(url: str) -> str:
    """Lower-case host, with the port unless it is the scheme's own."""
    host = f"lower({_part(url, _WEB, 2)})"
    scheme = f"lower({_part(url, _WEB, 1)})"
    own = f"CASE {scheme} WHEN 'http' THEN ':80' WHEN 'ws' THEN ':80' WHEN 'ftp' THEN ':21' ELSE ':443' END"
    return f"if(endswith({host}, {own}), left({host}, length({host}) - length({own})), {host})"


def encoded_path(path: str) -> str:
    """Non-ASCII characters and the few ASCII ones an address escapes, percent-encoded."""
    c = fresh("c")
    escape = lit(r"[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]")
    one = f"if({c} rlike {escape}, replace(url_encode({c}), '+', '%20'), {c})"
    return f"if({path} rlike {escape}, array_join(transform(split({path}, ''), {c} -> {one}), ''), {path})"


def mask_segment(segment: str) -> str:
    arms = " ".join(f"WHEN {segment} rlike {lit(p)} THEN {lit(mask)}" for p, mask in P.URL_MASKS)
    return f"(CASE {arms} ELSE {segment} END)"


def _masked(path: str) -> str:
    s = fresh("s")
    return f"array_join(transform(split({path}, '/'), {s} -> {mask_segment(s)}), '/')"


def url_template(url: str) -> str:
    """origin, path_template and has_query: the parts of an address that identify no one."""

    def web(u: str) -> str:
        path = f"coalesce(nullif({encoded_path(_part(u, _WEB, 3))}, ''), '/')"
        return (
            f"named_struct('origin', concat(lower({_part(u, _WEB, 1)}), '://', {_authority(u)}), "
            f"'path_template', {_masked(path)}, 'has_query', length({_part(u, _WEB, 4)}) > 1)"
        )

    def other(u: str) -> str:
        return (
            f"named_struct('origin', 'null', 'path_template', coalesce(nullif({_masked(_part(u, _OTHER, 2))}, ''), '/'), "
            f"'has_query', length({_part(u, _OTHER, 3)}) > 1)"
        )

    special = lit(r"^(?i)(https?|ftp|wss?):")
    unknown = "named_struct('origin', 'about:unknown', 'path_template', '/', 'has_query', false)"
    return let(
        f"coalesce(trim({url}), '')",
        lambda u: f"CASE WHEN {u} rlike {lit(_WEB)} THEN {web(u)} "
        f"WHEN {u} rlike {lit(_OTHER)} AND NOT {u} rlike {special} THEN {other(u)} ELSE {unknown} END",
    )


def host_of(url: str) -> str:
    """Host with its port; NULL when there is none."""
    return f"if({url} rlike {lit(_WEB)}, nullif({_authority(url)}, ''), NULL)"


def navigation_allowed(to: str, origin: str, strict: bool = False) -> str:
    """"back", a path, or the same origin. ``strict`` also refuses "//host", which a browser takes to another site."""
    path = f"startswith({to}, '/')" + (f" AND NOT {to} rlike {lit(r'^/[/\\]')}" if strict else "")
    same = let(url_template(to), lambda t: f"{t}.origin = {origin} AND {t}.origin <> 'about:unknown'")
    return f"(coalesce({to} = 'back' OR ({path}) OR {same}, false))"
