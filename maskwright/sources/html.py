"""Pages in, element rows out.

A small parser (the standard library's) gives the tags, attributes and texts
of one page as an array of nodes; everything that decides what a node is, is
called, holds and shows is a column expression over that array. One page is
one row throughout: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.sql import fresh, let, lit, lits, lookup, once
from maskwright.session import cut_lineage

# Tags without content, tags never rendered, and tags whose start closes an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNRENDERED = frozenset("head script style template noscript title meta link base".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
FENCES = frozenset("ul ol table select dl body article section div".split())

# Which tags are kept, and as what.
INTERACTIVE = ("button", "a", "input", "textarea", "select", "option")
STRUCTURAL = (
    "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "ul", "ol", "li", "form", "dialog", "section",
    "main", "nav", "aside",
)
PIXEL_TAGS = ("img", "canvas", "iframe", "video")
TEXT_TAGS = (
    "p", "span", "div", "label", "small", "strong", "em", "b", "i", "blockquote", "pre", "code", "figcaption",
    "caption", "dt", "dd",
)
TAG_ROLE = {
    "button": "button", "a": "link", "textarea": "textbox", "select": "combobox", "option": "option", "img": "image",
    "canvas": "canvas", "iframe": "iframe", "video": "video", "h1": "heading", "h2": "heading", "h3": "heading",
    "h4": "heading", "h5": "heading", "h6": "heading", "table": "table", "tr": "row", "td": "cell", "th": "cell",
    "ul": "list", "ol": "list", "li": "listitem", "form": "form", "dialog": "dialog", "section": "region",
    "main": "region", "nav": "region", "aside": "region",
    **{tag: "text" for tag in TEXT_TAGS},
}
INPUT_ROLE = {
    "checkbox": "checkbox", "radio": "radio", "range": "slider", "search": "searchbox", "submit": "button",
    "reset": "button", "button": "button", "image": "button",
}
EXPLICIT_ROLES = tuple(role for role in P.ROLES if role != "other")
NAMED_BY_CONTENT = ("button", "link", "heading", "option", "menuitem", "tab", "cell", "listitem", "text")
ENTRY_TYPES = ("text", "email", "password", "search", "tel", "url", "number")
NO_VALUE_TYPES = ("checkbox", "radio", "file", "hidden", "submit", "reset", "button", "image")
MAX_NAME = 200

_NODE = pa.struct(
    [
        ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("parent", pa.int32()),
        ("content", pa.string()), ("own_text", pa.bool_()), ("under_text", pa.bool_()), ("hidden", pa.bool_()),
        ("aria_hidden", pa.bool_()), ("disabled", pa.bool_()), ("editable", pa.bool_()), ("labels", pa.string()),
        ("labelled_by", pa.string()), ("options", pa.list_(pa.string())), ("chosen", pa.string()),
        ("in_dropdown", pa.bool_()), ("plain", pa.string()), ("depth", pa.int32()),
    ]
)
NODES_TYPE = (
    "array<struct<tag:string,attrs:map<string,string>,parent:int,content:string,own_text:boolean,under_text:boolean,"
    "hidden:boolean,aria_hidden:boolean,disabled:boolean,editable:boolean,labels:string,labelled_by:string,"
    "options:array<string>,chosen:string,in_dropdown:boolean,plain:string,depth:int>>"
)


class _Tree(HTMLParser):
    """Nodes in document order: tag, attributes, parent, and children as text or node numbers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.children: list[list[int | str]] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, {"p"} if tag in CLOSES_P else set())
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tags[self.open[depth]]
            if name in closes:
                del self.open[depth:]
                break
            if name in FENCES:
                break
        number = len(self.tags)
        parent = self.open[-1] if self.open else -1
        self.tags.append(tag)
        self.attrs.append({k: v if v is not None else "" for k, v in reversed(attrs)})
        self.parents.append(parent)
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(number)
        if tag not in VOID:
            self.open.append(number)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[depth]] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if self.open:
            self.children[self.open[-1]].append(data)


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def page_nodes(html: str) -> list[dict]:
    """The nodes of one page with the facts about their surroundings that a column cannot see."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    size = len(tree.tags)
    by_id = {a["id"]: n for n, a in reversed(list(enumerate(tree.attrs))) if "id" in a}
    labels_for: dict[int, list[int]] = {}
    own = [any(isinstance(c, str) and c.strip() for c in kids) for kids in tree.children]
    plain, content = [""] * size, [""] * size
    for n in range(size - 1, -1, -1):  # children have larger numbers, so they are ready
        plain[n] = "".join(c if isinstance(c, str) else plain[c] for c in tree.children[n])
        parts = []
        for c in tree.children[n]:
            if isinstance(c, str):
                parts.append(c)
                continue
            a = tree.attrs[c]
            if a.get("aria-hidden") == "true":
                continue
            name = _squeeze(a.get("aria-label", "")) or (_squeeze(a.get("alt", "")) if tree.tags[c] == "img" else "")
            if not name and tree.tags[c] == "svg":
                name = next((_squeeze(plain[k]) for k in range(c + 1, size) if tree.tags[k] == "title" and _inside(tree, k, c)), "")
            parts.append(f" {name} " if name else ("" if tree.tags[c] in UNRENDERED else content[c]))
        content[n] = "".join(parts)
    for n in range(size):
        if tree.tags[n] == "label":
            target = by_id.get(tree.attrs[n]["for"]) if "for" in tree.attrs[n] else next(
                (k for k in range(n + 1, size) if tree.tags[k] in ("input", "textarea", "select") and _inside(tree, k, n)), None
            )
            if target is not None:
                labels_for.setdefault(target, []).append(n)
    nodes: list[dict] = []
    for n in range(size):
        tag, attrs, parent = tree.tags[n], tree.attrs[n], tree.parents[n]
        above = nodes[parent] if parent >= 0 else None
        style = attrs.get("style", "").replace(" ", "").lower()
        hidden = (
            "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or tag in UNRENDERED
            or bool(above and above["hidden"])
        )
        text_holder = bool(above) and (
            above["under_text"] or (own[parent] and above["tag"] in TEXT_TAGS + INTERACTIVE)
        )
        editable = attrs.get("contenteditable")
        options, chosen = None, None
        if tag == "select":
            inside = [k for k in range(n + 1, size) if tree.tags[k] == "option" and _inside(tree, k, n)]
            options = [t for t in (_squeeze(plain[k]) for k in inside) if t]
            picked = [k for k in inside if "selected" in tree.attrs[k]] or inside[:1]
            chosen = _squeeze(plain[picked[-1]]) if picked else None
        seen: list[int] = []
        for ref in dict.fromkeys(attrs.get("aria-labelledby", "").split()):
            target = by_id.get(ref)
            if target is not None and not any(target == s or _inside(tree, target, s) for s in seen):
                seen.append(target)
        nodes.append(
            {
                "tag": tag, "attrs": list(attrs.items()), "parent": parent, "content": content[n], "own_text": own[n],
                "under_text": text_holder, "hidden": hidden,
                "aria_hidden": attrs.get("aria-hidden") == "true" or bool(above and above["aria_hidden"]),
                "disabled": "disabled" in attrs or bool(above and above["disabled"] and above["tag"] in ("fieldset", "optgroup", "select") ),
                "editable": (editable.lower() != "false") if editable is not None else bool(above and above["editable"]),
                "labels": " ".join(t for t in (_squeeze(plain[k])[:MAX_NAME] for k in labels_for.get(n, [])) if t),
                "labelled_by": " ".join(t for t in (_squeeze(plain[k])[:MAX_NAME] for k in seen) if t),
                "options": options, "chosen": chosen,
                "in_dropdown": tag == "option" and _in_dropdown(tree, n), "plain": plain[n],
                "depth": above["depth"] + 1 if above else 0,
            }
        )
    return nodes


def _inside(tree: _Tree, node: int, outer: int) -> bool:
    while node > outer:
        node = tree.parents[node]
    return node == outer


def _in_dropdown(tree: _Tree, node: int) -> bool:
    while node >= 0 and tree.tags[node] != "select":
        node = tree.parents[node]
    if node < 0:
        return False
    size = tree.attrs[node].get("size", "")
    return "multiple" not in tree.attrs[node] and not (size.isdigit() and int(size) > 1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A few pages at a time: nodes of a page are many times its size.
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            nodes = [page_nodes(html) for html in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("view_id"), pa.array(nodes, type=pa.list_(_NODE))], names=["view_id", "nodes"]
            )


def parse_pages(pages: DataFrame) -> DataFrame:
    """``view_id, html`` to ``view_id, nodes``."""
    kind = pages.schema["view_id"].dataType.simpleString()
    return pages.select("view_id", "html").mapInArrow(_parse, f"view_id {kind}, nodes {NODES_TYPE}")


def _attr(n: str, name: str) -> str:
    return f"element_at({n}.attrs, {lit(name)})"


def squeeze(text: str) -> str:
    """Trimmed, white space collapsed, cut at 200; NULL when nothing is left."""
    spaces = lit("[" + P.SPACE + "]+")
    return f"nullif(substring(trim(BOTH ' ' FROM regexp_replace({text}, {spaces}, ' ')), 1, {MAX_NAME}), '')"


def input_type(n: str) -> str:
    """The type of an input as the browser reads it: unknown or missing is text."""
    return f"if({n}.tag = 'input', lower(coalesce(nullif({_attr(n, 'type')}, ''), 'text')), NULL)"


def element_role(tag: str, kind: str, explicit: str) -> str:
    known = f"{explicit} IN ({lits(EXPLICIT_ROLES)})"
    by_input = f"coalesce({lookup(INPUT_ROLE, kind)}, 'textbox')"
    return f"(CASE WHEN {known} THEN {explicit} WHEN {tag} = 'input' THEN {by_input} ELSE coalesce({lookup(TAG_ROLE, tag)}, 'other') END)"


def is_relevant(n: str) -> str:
    role = f"trim({_attr(n, 'role')})"
    index = _attr(n, "tabindex")
    focusable = f"({index} rlike '^-?[0-9]+$' AND coalesce(try_cast({index} AS double), -2) >= -1)"
    text = f"({n}.tag IN ({lits(TEXT_TAGS)}) AND {n}.own_text AND NOT {n}.under_text)"
    return (
        f"(NOT {n}.in_dropdown AND NOT {n}.hidden AND NOT {n}.aria_hidden "
        f"AND NOT coalesce({input_type(n)} = 'hidden', false) AND coalesce("
        f"{n}.tag IN ({lits(INTERACTIVE + STRUCTURAL + PIXEL_TAGS)}) OR coalesce({role} IN ({lits(EXPLICIT_ROLES)}), false) "
        f"OR coalesce({focusable}, false) OR {n}.editable OR {text}, false))"
    )


def accessible_name(n: str, role: str) -> str:
    kind = input_type(n)
    caption = (
        f"CASE WHEN {kind} IN ('submit', 'reset', 'button') THEN coalesce({squeeze(_attr(n, 'value'))}, "
        f"CASE {kind} WHEN 'submit' THEN 'Submit' WHEN 'reset' THEN 'Reset' END) END"
    )
    entry = f"({n}.tag = 'textarea' OR coalesce({kind} IN ({lits(ENTRY_TYPES)}), false))"
    alt = f"if({n}.tag = 'img' OR coalesce({kind} = 'image', false), {squeeze(_attr(n, 'alt'))}, NULL)"
    return (
        f"coalesce({squeeze(_attr(n, 'aria-label'))}, {squeeze(n + '.labelled_by')}, {squeeze(n + '.labels')}, {caption}, "
        f"if({entry}, {squeeze(_attr(n, 'placeholder'))}, NULL), "
        f"if({role} IN ({lits(NAMED_BY_CONTENT)}), {squeeze(n + '.content')}, NULL), {squeeze(_attr(n, 'title'))}, {alt})"
    )


def element_value(n: str, role: str) -> str:
    """What a field holds, or the visible text of anything else."""
    kind = input_type(n)
    return (
        f"(CASE WHEN {n}.tag = 'input' THEN if({kind} IN ({lits(NO_VALUE_TYPES)}), NULL, {squeeze(_attr(n, 'value'))}) "
        f"WHEN {n}.tag = 'textarea' THEN {squeeze(n + '.plain')} WHEN {n}.tag = 'select' THEN {squeeze(n + '.chosen')} "
        f"WHEN {n}.editable THEN {squeeze(n + '.plain')} "
        f"WHEN {role} IN ({lits(NAMED_BY_CONTENT)}) OR {n}.own_text THEN {squeeze(n + '.content')} END)"
    )


def element_state(n: str) -> str:
    kind = input_type(n)

    def flag(name: str) -> str:
        v = f"lower(trim({_attr(n, name)}))"
        return f"(CASE {v} WHEN 'true' THEN true WHEN 'false' THEN false END)"

    native_off = f"({n}.tag IN ('button', 'input', 'select', 'textarea', 'option', 'optgroup', 'fieldset') AND {n}.disabled)"
    off = f"({native_off} OR coalesce({flag('aria-disabled')}, false))"
    box = f"coalesce({kind} IN ('checkbox', 'radio'), false)"
    checked = f"if({box}, map_contains_key({n}.attrs, 'checked'), {flag('aria-checked')})"
    selected = f"if({n}.tag = 'option', map_contains_key({n}.attrs, 'selected'), coalesce({flag('aria-selected')}, false))"
    required = (
        f"(({n}.tag IN ('input', 'textarea', 'select') AND map_contains_key({n}.attrs, 'required')) "
        f"OR coalesce({flag('aria-required')}, false))"
    )
    readonly = f"({n}.tag IN ('input', 'textarea') AND map_contains_key({n}.attrs, 'readonly'))"
    entry = f"({n}.tag = 'textarea' OR coalesce({kind} IN ({lits(ENTRY_TYPES)}), false) OR {n}.editable)"
    invalid = f"lower(trim({_attr(n, 'aria-invalid')})) IN ('true', 'grammar', 'spelling')"
    arms = (
        f"if({off}, 'disabled', NULL), CASE {checked} WHEN true THEN 'checked' WHEN false THEN 'unchecked' END, "
        f"if({selected}, 'selected', NULL), if({required}, 'required', NULL), if({readonly}, 'readonly', NULL), "
        f"if({entry} AND NOT {off} AND NOT {readonly}, 'editable', NULL), if(coalesce({invalid}, false), 'invalid', NULL), "
        f"CASE {flag('aria-expanded')} WHEN true THEN 'expanded' WHEN false THEN 'collapsed' END"
    )
    return f"array_compact(array({arms}))"


def html_elements(pages: DataFrame) -> DataFrame:
    """One row per kept element of every page, in document order. Layout columns are NULL: they need a browser."""
    n, i, k, x = fresh("n"), fresh("i"), fresh("k"), fresh("x")
    role_of = element_role(f"{n}.tag", input_type(n), f"trim({_attr(n, 'role')})")
    hint = squeeze(f"concat('options: ', array_join({n}.options, ' | '))")

    def described(role: str) -> str:
        return let(
            accessible_name(n, role),
            lambda name: let(
                element_value(n, role),
                lambda value: (
                    f"named_struct('parent', {n}.parent, 'depth', {n}.depth, 'role', {role}, 'label', {name}, "
                    f"'value', if({value} <=> {name}, NULL, {value}), "
                    f"'hint', if({n}.tag = 'select' AND size({n}.options) > 0, {hint}, NULL), "
                    f"'state', {element_state(n)}, 'input_type', {input_type(n)}, "
                    f"'autocomplete', if({n}.tag IN ('input', 'textarea', 'select'), nullif(trim({_attr(n, 'autocomplete')}), ''), NULL))"
                ),
            ),
        )

    numbered = f"transform(nodes, ({x}, {i}) -> named_struct('node', {i}, 'n', {x}))"
    kept = parse_pages(pages).selectExpr(
        "view_id", "transform(nodes, x -> x.parent) AS parents",
        once(f"filter({numbered}, {k} -> {is_relevant(k + '.n')})") + " AS kept",
    )
    told = f"transform(kept, {k} -> get(transform(array({k}.n), {n} -> {let(role_of, described)}), 0))"
    rows = kept.selectExpr(
        "view_id", "parents", "transform(kept, x -> x.node) AS kept_nodes",
        f"posexplode({once(told)}) AS (ordinal, e)",
    )
    # The nearest kept ancestor: walk up the parents.
    up = (
        "aggregate(sequence(0, e.depth), named_struct('at', e.parent, 'done', false), "
        "(a, s) -> if(a.done OR a.at < 0, a, if(array_contains(kept_nodes, a.at), named_struct('at', a.at, 'done', true), "
        "named_struct('at', get(parents, a.at), 'done', false))), a -> if(a.done, array_position(kept_nodes, a.at), NULL))"
    )
    return rows.selectExpr(
        "view_id", "ordinal", "concat('e', ordinal + 1) AS id", "e.role AS role", "e.label AS label", "e.value AS value",
        "e.hint AS hint", "cast(NULL AS struct<x:double,y:double,w:double,h:double>) AS bbox", "e.state AS state",
        "'dom' AS source", "cast(NULL AS double) AS confidence", f"concat('e', {up}) AS parent_id",
        "e.input_type AS input_type", "e.autocomplete AS autocomplete",
    )


def with_children(elements: DataFrame) -> DataFrame:
    """Each element with the ids of its children, from the nearest kept ancestor of every element."""
    elements = cut_lineage(elements)  # read on both sides of the join: pages are parsed once
    children = (
        elements.where("parent_id IS NOT NULL")
        .groupBy("view_id", "parent_id")
        .agg(_ordered_ids())
        .withColumnRenamed("parent_id", "id")
    )
    return elements.join(children, ["view_id", "id"], "left")


def _ordered_ids() -> Column:
    return F.expr("transform(array_sort(collect_list(struct(ordinal, id))), x -> x.id)").alias("children")
