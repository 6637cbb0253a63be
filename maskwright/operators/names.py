"""Which names are private: on personal pages all of them, elsewhere those that address the user, and any already learned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions.batches import with_spans
from maskwright.functions.detectors import EMAIL, field_category, rlike
from maskwright.functions.spans import NO_SPANS, find, resolve_overlaps, span
from maskwright.functions.sql import fresh, lit, once
from maskwright.functions.urls import url_template
from maskwright.operators import vault as tokens
from maskwright.operators.entities import NAME_PRIORITY
from maskwright.operators.skew import join_salted, shuffled
from maskwright.operators.views import detect_view_texts, neighbour_label, view_texts
from maskwright.session import cut_lineage

GOAL_SEQ = -1


def personal_views(texts: DataFrame, elements: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """``view_id, personal``: a face, a structured detection, a labelled one, or a filled-in private field."""
    return _personal(with_spans(texts.select("view_id", "text"), merge=None), elements, faces)


def _personal(read: DataFrame, elements: DataFrame, faces: DataFrame | None) -> DataFrame:
    """:func:`personal_views` of texts whose candidates are known, as ``spans``."""
    by_text = read.selectExpr("view_id", "size(spans) > 0 AS hit")
    # The label itself was read with the texts; here only "neighbour: label" counts, prefix and all.
    near = neighbour_label(elements).where("neighbour IS NOT NULL").selectExpr("view_id", "concat(neighbour, ': ', label) AS text")
    labelled = with_spans(near, merge=None).selectExpr("view_id", "size(spans) > 0 AS hit")
    fields = elements.where("trim(value) <> ''").selectExpr(
        "view_id", f"(coalesce(input_type = 'password', false) OR {field_category('input_type', 'autocomplete')} IS NOT NULL) AS hit"
    )
    flags = by_text.unionByName(labelled).unionByName(fields)
    if faces is not None:
        flags = flags.unionByName(faces.selectExpr("view_id", "true AS hit"))
    return flags.groupBy("view_id").agg(F.expr("coalesce(bool_or(hit), false)").alias("personal"))


def mentions_cue(text: str) -> str:
    return rlike(text, P.CUE_MENTION)


def ner_candidates(texts: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Distinct texts worth a model call: all on personal views, those with a cue elsewhere, none already scanned.

    ``texts`` holds ``text`` and ``personal``.
    """
    wanted = texts.where(f"text rlike {lit('[^' + P.SPACE + ']')} AND (personal OR {mentions_cue('text')})").select("text").distinct()
    return wanted if scanned is None else wanted.join(scanned.select("text").distinct(), "text", "left_anti")


def after_cues(text: str, spans: str) -> str:
    """Spans right after a cue, and those that follow a kept one with only punctuation between."""
    a, s = fresh("a"), fresh("s")
    between = f"substring({text}, {a}.last + 1, {s}.start - {a}.last)"
    goes_on = f"({a}.last >= 0 AND {between} rlike {lit('^[' + P.SPACE + r',;:()-]*\z')})"
    cued = rlike(f"substring({text}, 1, {s}.start)", P.CUE_BEFORE)
    return (
        f"aggregate(array_sort({spans}), named_struct('last', -1, 'kept', {NO_SPANS}), ({a}, {s}) -> "
        f"if({goes_on} OR {cued}, named_struct('last', {s}.end, 'kept', concat({a}.kept, array({s}))), {a}), {a} -> {a}.kept)"
    )


def name_from_email(email: str) -> str:
    """The name an address spells out: a local part of two or more plain words."""
    local = f"split_part({email}, '@', 1)"
    return f"if({rlike(local, P.NAME_LOCAL_PART)}, regexp_replace({local}, '[._-]+', ' '), NULL)"


def known_key(value: str) -> str:
    spaces = lit("[" + P.SPACE + "]+")
    return f"trim(regexp_replace(lower({value}), {spaces}, ' '))"


def email_names(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, value, category`` of names spelled out by addresses in the texts."""
    return _spelled(with_spans(texts.select(*keys, "text"), detectors=(EMAIL,), merge=None), keys)


def _spelled(read: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`email_names` of texts whose candidates are known, as ``spans``."""
    found = read.selectExpr(*keys, f"explode(filter(spans, s -> s.category = {lit(EMAIL.category)})) AS s")
    return found.selectExpr(*keys, f"{name_from_email('s.text')} AS value", "'NAME' AS category").where("value IS NOT NULL")


def field_names(elements: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, value, category`` of filled NAME and ADDRESS fields."""
    category = field_category("input_type", "autocomplete")
    return elements.selectExpr(*keys, "value", f"{category} AS category").where("category IN ('NAME', 'ADDRESS') AND value <> ''")


def learn_names(values: DataFrame) -> DataFrame:
    """``task_id, key, category, known_from`` of at least 3 characters; the first category seen wins.

    ``values``: task_id, view_seq, learn_order, value, category. Two partial
    aggregates per key: a hot task costs nothing more.
    """
    keyed = values.selectExpr("task_id", "view_seq", "learn_order", f"{known_key('value')} AS key", "category")
    return keyed.where(f"length(key) >= {P.MIN_KNOWN_LENGTH}").groupBy("task_id", "key").agg(
        F.expr("min_by(category, struct(view_seq, learn_order))").alias("category"), F.min("view_seq").alias("known_from")
    )


_RUN = r"[\p{L}\p{N}]+"


def _core(value: str) -> str:
    return f"regexp_replace({value}, {lit(r'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$')}, '')"


def known_in(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``text_id, spans``: known values in each text, whatever their case or spacing, from the view that learned them on.

    ``texts``: text_id, task_id, view_seq, text. Each text gives its runs of n
    words, for the n the task knows of, and meets the known values in one
    equi-join on (task, words); the order test is a filter on the match.
    """
    # Met twice below: what was learned is not to be learned again for it.
    k = cut_lineage(known.selectExpr(
        "task_id", "key", "category", "known_from", f"{_core('key')} AS core",
        f"regexp_extract(key, {lit(r'^[^\p{L}\p{N}]*')}, 0) AS lead",
        f"regexp_extract(key, {lit(r'[^\p{L}\p{N}]*$')}, 0) AS trail",
    ).where("core <> ''"))
    sizes = k.groupBy("task_id").agg(F.expr(f"array_sort(collect_set(regexp_count(core, {lit(_RUN)})))").alias("sizes"))
    words = join_salted(texts.select("text_id", "task_id", "view_seq", "text"), sizes, ["task_id"], ["text_id"])
    i, n = fresh("i"), fresh("n")
    last = f"get(words, {i} + {n} - 1).end"
    grams = (
        words.withColumn("words", F.expr(once(find("text", lit(_RUN)))))
        .where("size(words) > 0")
        .selectExpr(
            "text_id", "task_id", "view_seq", "text",
            f"inline(flatten(transform(sequence(0, size(words) - 1), {i} -> transform(filter(sizes, {n} -> {i} + {n} <= size(words)), "
            f"{n} -> named_struct('start', get(words, {i}).start, 'end', {last}, 'core', "
            f"{known_key(f'substring(text, get(words, {i}).start + 1, {last} - get(words, {i}).start)')})))))",
        )
    )
    met = join_salted(
        grams.select("text_id", "task_id", "view_seq", "start", "end", "core"), k, ["task_id", "core"], ["text_id", "start"]
    ).where("known_from <= view_seq")
    found = met.groupBy("text_id").agg(
        F.expr("collect_list(struct(start, `end`, category, lead, trail))").alias("found")
    )
    s, o = fresh("s"), fresh("o")
    lead_at = f"({s}.start - length({s}.lead))"
    trail_to = f"({s}.end + length({s}.trail))"
    # A value that starts or ends with punctuation needs it around the words, and no word right outside it.
    fits = (
        f"({lead_at} >= 0 AND lower(substring(text, {lead_at} + 1, length({s}.lead))) = {s}.lead "
        f"AND lower(substring(text, {s}.end + 1, length({s}.trail))) = {s}.trail "
        f"AND ({s}.lead = '' OR {lead_at} = 0 OR NOT substring(text, {lead_at}, 1) rlike {lit(_RUN)}) "
        f"AND ({s}.trail = '' OR NOT substring(text, {trail_to} + 1, 1) rlike {lit(_RUN)}))"
    )
    one = span(
        lead_at, trail_to, f"{s}.category", lit("ner"), "0.9D", str(NAME_PRIORITY + 1),
        f"substring(text, {lead_at} + 1, {trail_to} - {lead_at})",
    )
    return texts.select("text_id", "text").join(shuffled(found), "text_id").selectExpr(
        "text_id", f"{resolve_overlaps(f'transform(filter(found, {o} -> true AND {fits.replace(s + chr(46), o + chr(46))}), {s} -> {one})')} AS spans"
    ).where("size(spans) > 0")


def chosen_spans(text: str, spans: str, personal: str) -> str:
    """The finder's spans that count on this view: all when it is personal, those after cues when it is not."""
    return f"if({personal}, {spans}, {after_cues(text, spans)})"


def name_spans(chosen: str, known: str) -> str:
    """Chosen spans, and the known ones that touch none of them."""
    c, k = fresh("c"), fresh("k")
    return (
        f"concat({chosen}, filter({known}, {k} -> NOT exists({chosen}, {c} -> {k}.start < {c}.end AND {k}.end > {c}.start)))"
    )


def choose_and_learn(texts: DataFrame, personal: DataFrame, entities: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``texts`` with the finder's ``chosen`` spans, the names each task knows): see :func:`policy`."""
    flagged = texts.join(shuffled(personal), "view_id", "left").join(shuffled(entities), "text_id", "left")
    chosen = flagged.withColumn(
        "chosen",
        F.expr(
            f"if(found IS NULL, {NO_SPANS}, {chosen_spans('text', 'found', f'(view_seq = {GOAL_SEQ} OR coalesce(personal, false))')})"
        ),
    )
    values = chosen.selectExpr("task_id", "view_seq", "1L + text_order AS learn_order", "explode(chosen) AS s").selectExpr(
        "task_id", "view_seq", "learn_order", "s.text AS value", "s.category AS category"
    )
    return chosen.drop("found"), learn_names(values if extra is None else values.unionByName(extra))


def with_names(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """The chosen spans, and each known value wherever it stands from the view on that learned it, as ``names``."""
    seen = known_in(chosen, known).withColumnRenamed("spans", "known")
    joined = chosen.join(shuffled(seen), "text_id", "left")
    return joined.withColumn("names", F.expr(name_spans("chosen", f"coalesce(known, {NO_SPANS})"))).drop("chosen", "known")


def policy(texts: DataFrame, personal: DataFrame, entities: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``texts`` with their name spans under the whole policy.

    ``texts``: task_id, view_seq, view_id, text_id, text_order, text, where a
    goal is a view with view_seq -1 and mode all. ``entities``: text_id, found
    (spans). ``extra``: values known from fields and addresses, as for
    ``learn_names``. Names are learned before the same view is redacted.
    """
    chosen, learned = choose_and_learn(texts, personal, entities, extra)
    return with_names(cut_lineage(chosen), learned)


def redact_private(
    views: DataFrame, elements: DataFrame, goals: DataFrame, late: DataFrame, finder: Callable[[str], str], faces: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(redacted texts, view paths without known names, vault): all that leaves for a task, in one plan.

    ``views``: view_id, task_id, view_seq, title, url. ``elements``: theirs. ``goals``: task_id, text; read before any
    view, every name in them private. ``late``: view_id, part, text of what comes after a view was read (answers,
    extracted values): names known by then are hidden in them. ``finder``: SQL for the entity spans of a text; for a
    model, join its spans to the texts and pass a column. Failed finders are the caller's: see :func:`fail_closed`.
    """
    own = views.selectExpr("cast(view_id AS string) AS view_id", "task_id", "view_seq", "title", "url")
    parts = elements.withColumn("view_id", F.expr("cast(view_id AS string)"))
    none = "cast(NULL AS string)"
    bare = f"{none} AS context", f"{none} AS input_type", f"{none} AS autocomplete"
    after = late.selectExpr("cast(view_id AS string) AS view_id", "2147483647 AS ordinal", "part", "1 AS part_order", "text", *bare)
    shown = view_texts(own, parts).unionByName(after).join(shuffled(own.select("view_id", "task_id", "view_seq")), "view_id")
    asked = goals.selectExpr(
        "concat('goal|', task_id) AS view_id", "0 AS ordinal", "'goal' AS part", "0 AS part_order", "text", *bare, "task_id",
        f"cast({GOAL_SEQ} AS bigint) AS view_seq",
    )
    texts = shown.withColumn("view_seq", F.expr("cast(view_seq AS bigint)")).unionByName(asked).where("text IS NOT NULL").selectExpr(
        "*", "concat_ws('|', view_id, ordinal, part) AS text_id", "cast(ordinal AS bigint) * 4 + part_order AS text_order"
    )
    # Read once for all that follows: the texts, their patterns and what the finder says.
    read = cut_lineage(with_spans(texts, merge=None).withColumn("found", F.expr(once(finder("text")))))
    texts = read.drop("spans", "found")
    # What an address or a field spells out is learned before the names of the same view.
    spelled = _spelled(read, ["task_id", "view_seq"]).unionByName(
        field_names(texts.where("part = 'value'").withColumnRenamed("text", "value"), ["task_id", "view_seq"])
    ).withColumn("learn_order", F.lit(0).cast("bigint"))
    personal = _personal(read.where("part NOT IN ('goal', 'after', 'extract')"), parts, faces)
    chosen, learned = choose_and_learn(texts, personal, read.select("text_id", "found"), spelled)
    chosen, learned = cut_lineage(chosen), cut_lineage(learned)
    # Redaction reads the texts twice: the joins that found their spans are not to run again for it.
    spans = cut_lineage(detect_view_texts(with_names(chosen, learned), "names").drop("names", "personal"))
    redacted, vault = tokens.redact(spans, ["task_id"], ["view_seq", "text_order"], bucket_rows=1)
    urls = own.selectExpr("view_id AS url_id", "task_id", "cast(view_seq AS bigint) AS view_seq", f"{url_template('url')} AS u")
    paths = hide_names_in_path(urls.selectExpr("url_id", "task_id", "view_seq", "u.path_template AS path_template"), learned)
    return redacted, paths.withColumnRenamed("url_id", "view_id"), vault


def fail_closed(rows: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of tasks whose name finder worked, per failed task the rows held back)."""
    failed = status.where("names_status = 'failed'").select("task_id").distinct()
    held = rows.join(failed, "task_id", "left_semi").groupBy("task_id").agg(F.count("*").alias("held"))
    return rows.join(failed, "task_id", "left_anti"), held


def hide_names_in_path(urls: DataFrame, known: DataFrame) -> DataFrame:
    """``url_id, path``: path segments that hold a known name become {name}.

    ``urls``: url_id, task_id, view_seq, path_template.
    """
    keyed = urls.where("path_template IS NOT NULL").withColumn("_key", F.expr("concat_ws('|', url_id)"))
    parts = keyed.selectExpr("_key", "task_id", "view_seq", "posexplode(split(path_template, '/')) AS (pos, segment)")
    spaced = "regexp_replace(coalesce(try_url_decode(segment), segment), '[-_+.]+', ' ')"
    texts = parts.where("segment <> '' AND NOT startswith(segment, '{')").selectExpr(
        "concat_ws('|', _key, pos) AS text_id", "task_id", "view_seq", f"{spaced} AS text"
    )
    named = known_in(texts, known.where("category = 'NAME'")).selectExpr("text_id", "substring_index(text_id, '|', -1) AS pos")
    hidden = named.groupBy(F.expr("left(text_id, length(text_id) - length(pos) - 1)").alias("_key")).agg(F.expr("collect_set(cast(pos AS int))").alias("_hidden"))
    masked = "array_join(transform(split(path_template, '/'), (s, i) -> if(array_contains(_hidden, i), '{name}', s)), '/')"
    return keyed.join(shuffled(hidden), "_key", "left").selectExpr("url_id", f"{masked} AS path")
