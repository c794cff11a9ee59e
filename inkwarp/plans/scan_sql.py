"""DuckDB forms of protected spans, structure and the rule scan: chains of common table expressions over ``docs`` (document_id, text).

Patterns are those of the operators; Java's Unicode classes are written out, a look-behind as the character before (of a text with one more
in front), a look-ahead as a check of what follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from inkwarp.functions import spans as protect
from inkwarp.functions.spans import MARKER
from inkwarp.operators import scan as scanning
from inkwarp.operators.rules import Allowance, Rule

SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
FENCE = "(?ms)^```[^\\n]*\\n.*?^```[ \\t]*$"
DOCS = "docs as (select document_id, min(text) as text from manuscripts where text is not null group by document_id)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern with ``\\s`` and ``\\d`` as Unicode has them and without Java's flags for them."""
    for flags, plain in (("(?dU)", ""), ("(?U)", ""), ("(?d)", ""), ("(?isU)", "(?is)")):
        pattern = pattern.replace(flags, plain)
    return pattern.replace("\\s", SPACE).replace("\\d", "\\p{Nd}")


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def starts(rows: str, name: str, by: str, texts: str, pattern: str) -> str:
    """CTE ``name``: ``by`` columns, start_pos and value of every match of ``pattern`` (an expression) in ``texts`` of ``rows``."""
    return f"""{name}_cut as (select {by}, string_split_regex({texts}, {pattern}) as g, regexp_extract_all({texts}, {pattern}) as h from {rows}),
{name} as (select {by}, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) as integer) as start_pos, h[i] as value
  from {name}_cut, unnest(range(1, len(h) + 1)) as u(i) where len(h) > 0)"""


def masked(x: str, pattern: str) -> str:
    """Every match blanked but for line feeds."""
    p = quoted(pattern)
    return f"array_to_string(list_transform(range(1, len(string_split_regex({x}, {p})) + 1), lambda i: string_split_regex({x}, {p})[i] || coalesce(regexp_replace(regexp_extract_all({x}, {p})[i], '[^\\n]', ' ', 'g'), '')), '')"


def protected(docs: str = "docs", name: str = "prot") -> str:
    """CTE ``name``: document_id, kind, start_pos, end_pos, value."""
    kinds = (("protected_block", protect.block_pattern(MARKER)), ("blockquote", "(?m)(?:^>[^\\n]*\\n?)+"), ("quotation", protect.QUOTATION), ("date", protect.DATE), ("statute", protect.STATUTE))
    values = ", ".join(f"({quoted(k)}, {quoted(re2(p))})" for k, p in kinds)
    number = quoted("[^\\p{Nd}가-힣]" + re2(protect.NUMBER).replace("(?<![\\p{Nd}가-힣])", ""))
    return f"""{name}_p(kind, pattern) as (values {values}), {name}_d as (select * from {docs}, {name}_p),
{starts(name + "_d", name + "_f", "document_id, kind", "text", "pattern")},
{name}_o as (select document_id, kind, start_pos, cast(start_pos + length(value) as integer) as end_pos, value from {name}_f),
{starts(docs, name + "_n", "document_id", "(chr(1) || text)", number)},
{name}_m as (select document_id, 'number' as kind, start_pos, cast(start_pos + length(value) - 1 as integer) as end_pos, substr(value, 2) as value from {name}_n),
{name} as (select * from {name}_o union all select * from {name}_m m where not exists (select 1 from {name}_o o where o.document_id = m.document_id and m.start_pos < o.end_pos and m.end_pos > o.start_pos))"""


def structure(docs: str = "docs", text: str = "text", name: str = "par") -> str:
    """CTE ``name``: paragraphs with offsets, kind, heading, sentences (list of start and end), section path and body rank."""
    head = "trim(line, ' ' || chr(9) || chr(13) || chr(160) || chr(12288))"
    sentence = quoted("[^.!?\\n]+(?:[.!?]+(?:\\*\\*)?|$)")
    return f"""{name}_l as (select document_id, {text} as t, i, string_split({text}, chr(10))[i] as line, cast(coalesce(list_sum(list_transform(string_split({text}, chr(10))[1:i-1], lambda x: length(x) + 1)), 0) as integer) as pos from {docs}, unnest(range(1, len(string_split({text}, chr(10))) + 1)) as u(i)),
{name}_g as (select *, sum(case when blank then 1 else 0 end) over (partition by document_id order by i) as grp from (select *, regexp_full_match(line, '{SPACE}*') as blank from {name}_l)),
{name}_p as (select document_id, any_value(t) as t, cast(min(pos) as integer) as start_pos, cast(least(max(pos + length(line) + 1), any_value(length(t))) as integer) as end_pos, count(*) as n, min_by(line, i) as line from {name}_g where not blank group by document_id, grp),
{name}_k as (select *, n = 1 and regexp_full_match({head}, '#{{1,6}}[ \\t]+[^\\n]+') as is_head from {name}_p),
{name}_h as (select document_id, t, start_pos, end_pos, cast(row_number() over w as integer) as paragraph, case when is_head then 'heading' else 'body' end as kind, case when is_head then regexp_replace({head}, '^#+[ \\t]+', '') else '' end as heading,
  case when is_head then length(regexp_extract({head}, '^(#+)', 1)) else 0 end as level, cast(sum(case when is_head then 0 else 1 end) over w as integer) as bodies, list(case when is_head then struct_pack(l := length(regexp_extract({head}, '^(#+)', 1)), p := [regexp_replace({head}, '^#+[ \\t]+', '')]) end) over w as above
  from {name}_k window w as (partition by document_id order by start_pos)),
{name}_b as (select *, start_pos as base, list_filter(above, lambda x: x is not null) as heads, regexp_replace(substr(t, start_pos + 1, end_pos - start_pos), '\\n$', '') as body from {name}_h),
{starts(f"{name}_b", name + "_x", "document_id, paragraph, base", "body", sentence)},
{name}_y as (select document_id, paragraph, list(struct_pack(s := cast(base + start_pos as integer), e := cast(base + start_pos + length(value) as integer)) order by start_pos) as found from {name}_x where not regexp_full_match(value, '{SPACE}*') group by all),
{name} as (select b.document_id, b.t, b.paragraph, b.start_pos, b.end_pos, b.kind, b.heading, b.bodies, coalesce(y.found, [struct_pack(s := b.start_pos, e := b.end_pos)]) as sentences,
  case when len(heads) = 0 then '' else array_to_string(list_reduce(heads, lambda a, x: struct_pack(l := x.l, p := list_concat(a.p[1:x.l - 1], x.p))).p, ' > ') end as section_heading, max(b.bodies) over (partition by b.document_id) as all_bodies
  from {name}_b b left join {name}_y y using (document_id, paragraph))"""


def _triad() -> str:
    """The chain's pattern with the terminator that has to follow."""
    join = f"(?:고|며)(?:{SPACE}*,{SPACE}*|{SPACE}+)"
    return f"[^.!?\\n,]{{0,35}}?[^.!?\\n,다라냐자]{join}[^.!?\\n,]{{0,27}}?[^.!?\\n,다라냐자]{join}[^.!?\\n]{{1,40}}[.!?]"


#: Rules with a look-behind or look-ahead: pattern without them, and what must hold of the characters before and after.
_CHECKED = {
    "KH-S01": ("(?:은|는|이|가)\\s+아니라", "true", "after <> '고'"),
    "KH-S04": ("(?:한편(?:으로)?|또한|다만|즉|나아가|아울러|다시\\s+말해)", "not regexp_matches(before, '[가-힣]')", "not regexp_matches(after, '[가-힣]')"),
}


def findings(rules: Sequence[Rule], docs: str = "docs", name: str = "found", allow: Sequence[Allowance] = (), listed: str | None = None) -> str:
    """CTEs up to ``name``: the findings of the rules in ``docs``, with the columns of the scan (offsets and lines under their table names).

    ``listed`` is a query that gives more rules of the regex type, as (id, pattern).
    """
    n = name
    plain = [(r.id, re2(r.pattern), "") for r in rules if r.anchor_type == "regex" and r.id not in _CHECKED]
    plain += [(r.id, _triad(), "triad") for r in rules if r.anchor_type == "triadic_chain"]
    plain += [(r.id, re2(_CHECKED[r.id][0]), "checked") for r in rules if r.id in _CHECKED]
    checks = " ".join(f"when rule_id = '{i}' then {b} and {a}" for i, (_, b, a) in _CHECKED.items())
    values = "values " + ", ".join(f"({quoted(i)}, {quoted(p)}, {quoted(how)})" for i, p, how in plain)
    values += f" union all select *, '' from ({listed})" if listed else ""
    runs = " union all ".join(
        f"""select document_id, '{r.id}' as rule_id, min(start_pos) as start_pos, max(end_pos) as end_pos, key || ' 종결 ' || count(*) || '문장 연속' as evidence, cast(null as varchar) as shape
  from (select *, i - row_number() over (partition by document_id, key order by i) as island from {n}_s where key is not null) group by document_id, key, island having count(*) >= {r.minimum_run}"""
        for r in rules
        if r.anchor_type == "sentence_run"
    )
    kinds = {"meta_discourse": scanning.META, "return_signal": (scanning.RETURN,), "advance_label": scanning.ADVANCE}
    inside = [(r.id, re2(p), label, shape, r.structural_kind) for r in rules if r.structural_kind in kinds for p, label, shape in kinds[r.structural_kind]]
    bold = [r for r in rules if r.structural_kind == "emphasis_run"]
    lead = strip(f"regexp_extract({strip('substr(t, start_pos + 1, end_pos - start_pos)')}, {quoted(scanning.BOLD_LEAD)}, 1)")
    parts = [f"select document_id, rule_id, start_pos, end_pos, evidence, shape from {n}_r"] if plain else []
    if runs:
        parts.append(f"select * from ({runs})")
    ctes = [
        f"{n}_c as (select document_id, text, {masked('text', '(?s)<!--.*?-->')} as o from {docs})",
        f"{n}_t as (select document_id, text, {masked('o', FENCE)} as t from {n}_c)",
        protected(docs, f"{n}_prot"),
        structure(f"{n}_t", "t", f"{n}_par"),
    ]
    clash = f"exists (select 1 from {n}_prot p where p.document_id = h.document_id and h.start_pos < p.end_pos and h.end_pos > p.start_pos)"
    if plain:
        ctes += [
            f"{n}_rp(rule_id, pattern, how) as ({values}), {n}_rd as (select * from {n}_t, {n}_rp)",
            starts(f"{n}_rd", f"{n}_rs", "document_id, rule_id, how", "t", "pattern"),
            f"""{n}_rc as (select s.document_id, rule_id, how, start_pos, value, case when start_pos = 0 then '' else substr(t, start_pos, 1) end as before, substr(t, cast(start_pos + length(value) + 1 as integer), 1) as after, substr(t, cast(start_pos + length(value) + 1 as integer)) as rest from {n}_rs s join {n}_t using (document_id)),
{n}_re as (select document_id, rule_id, how, start_pos, case when how = 'triad' then value[:-2] when rule_id = 'KH-S04' then value || regexp_extract(rest, '^{SPACE}*[,，]') else value end as value from {n}_rc where how <> 'checked' or case {checks} end),
{n}_rh as (select document_id, rule_id, start_pos, cast(start_pos + length(value) as integer) as end_pos, case when how = 'triad' then {quoted(scanning.TRIAD_LABEL)} || {strip("value")} else value end as evidence, case when how = 'triad' then {quoted(scanning.TRIAD_SHAPE)} end as shape from {n}_re),
{n}_r as (select * from {n}_rh h where not {clash})""",
        ]
    if runs:
        ctes += [
            starts(f"{n}_t", f"{n}_sa", "document_id", "t", quoted(scanning.RUN_SENTENCE)),
            f"""{n}_sb as (select document_id, start_pos, cast(start_pos + length(value) as integer) as end_pos, value, row_number() over (partition by document_id order by start_pos) as i from {n}_sa),
{n}_s as (select document_id, i, start_pos, end_pos, case when not {clash} then nullif(regexp_extract({strip("value")}, {quoted(scanning.RUN_ENDING)}, 1), '') end as key from {n}_sb h)""",
        ]
    if inside:
        labelled = ", ".join("(" + ", ".join(quoted(x) for x in row) + ")" for row in inside)
        first = "((sentences[1].s <= start_pos and sentences[1].e > start_pos) or len(sentences) = 1)"
        ctes += [
            f"{n}_ip(rule_id, pattern, label, shape, how) as (values {labelled}), {n}_id as (select document_id, paragraph, start_pos as base, sentences, substr(t, start_pos + 1, end_pos - start_pos) as body, p.* from {n}_par, {n}_ip p where kind = 'body')",
            starts(f"{n}_id", f"{n}_is", "document_id, base, sentences, rule_id, label, shape, how", "body", "pattern"),
            f"""{n}_ih as (select document_id, rule_id, how, sentences, cast(base + start_pos as integer) as start_pos, cast(base + start_pos + length(value) as integer) as end_pos, value, label || ': ' || value as evidence, shape from {n}_is),
{n}_i as (select * from {n}_ih h where not {clash} and (how <> 'meta_discourse' or not contains(value, '돌아가자') and {first}))""",
        ]
        parts.append(f"select document_id, rule_id, start_pos, end_pos, evidence, shape from {n}_i")
    for r in bold:
        navigation = quoted(re2(scanning.NAVIGATION))
        ctes.append(f"""{n}_bk as (select *, case when kind = 'body' and lead <> '' and length(lead) <= 52 and not regexp_matches(lead, {navigation}) then 'bold' end as key from (select *, {lead} as lead from {n}_par)),
{n}_bi as (select document_id, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n from (select *, paragraph - row_number() over (partition by document_id, key order by paragraph) as island from {n}_bk where key is not null) group by document_id, island having count(*) >= {r.minimum_run or 3})""")
        parts.append(f"select document_id, '{r.id}', start_pos, end_pos, '굵은 도입 라벨 ' || n || '문단 연속', '굵은 도입 라벨 연속' from {n}_bi h where not {clash}")
    fits = {"all": "true", "heading": "paragraph_kind = 'heading'", "body": "paragraph_kind = 'body'", "first_sentence": "paragraph_kind = 'body' and is_paragraph_first"}
    given = lambda what: "case " + " ".join(f"when rule_id = {quoted(a.rule_id)} and {fits[a.scope]} then {quoted(getattr(a, what))}" for a in allow) + " end" if allow else "cast(null as varchar)"
    ctes.append(f"""{n}_h as ({" union all ".join(parts)}),
{n}_l as (select h.*, d.text, p.paragraph as pp, p.kind, p.section_heading as sh, p.sentences as ss, p.bodies, p.all_bodies, len(list_filter(p.sentences, lambda s: s.e <= h.start_pos)) as ended
  from {n}_h h join {docs} d using (document_id) left join {n}_par p on p.document_id = h.document_id and p.start_pos = (select max(q.start_pos) from {n}_par q where q.document_id = h.document_id and q.start_pos <= h.start_pos)),
{n}_m as (select *, case when pp is null then 0 when ended < len(ss) and ss[ended + 1].s <= start_pos then ended + 1 else len(ss) end as sentence from {n}_l),
{n}_q as (select document_id, rule_id, cast(start_pos as integer) as start_pos, cast(end_pos as integer) as end_pos, cast(length(substr(text, 1, start_pos)) - length(replace(substr(text, 1, start_pos), chr(10), '')) + 1 as integer) as line_no, cast(length(string_split(substr(text, 1, start_pos), chr(10))[-1]) + 1 as integer) as column_no, evidence,
  trim(regexp_replace(substr(text, greatest(start_pos - 24, 0) + 1, end_pos + 24 - greatest(start_pos - 24, 0)), '{SPACE}+', ' ', 'g')) as context, coalesce(pp, 0) as paragraph, cast(sentence as integer) as sentence_in_paragraph, coalesce(sentence = 1, false) as is_paragraph_first, coalesce(sentence = len(ss), false) as is_paragraph_last, coalesce(kind, 'unknown') as paragraph_kind, coalesce(sh, '') as section_heading,
  coalesce(kind = 'body' and bodies = all_bodies, false) as is_document_last, cast(case when kind = 'body' then all_bodies - bodies + 1 else 0 end as integer) as body_paragraphs_to_end, shape from {n}_m),
{n} as (select *, allow_scope is not null as allowed from (select *, {given("scope")} as allow_scope, {given("reason")} as allow_reason from {n}_q))""")
    return ",\n".join(ctes)


def rhythm(docs: str = "docs") -> str:
    """The paragraph rhythm of every document, as a whole query."""
    lines = f"list_filter(string_split(raw, chr(10)), lambda x: not regexp_full_match(x, '{SPACE}*'))"
    every = lambda pattern: f"len({lines}) > 0 and len(list_filter({lines}, lambda x: not regexp_matches(x, {quoted(re2(pattern))}))) = 0"
    raw = strip("substr(t, start_pos + 1, end_pos - start_pos)")
    left = ", ".join(f"count(*) filter (where what = '{k}') as excluded_{k}" for k in ("heading", "blockquote", "list", "table", "horizontal_rule"))
    prose = "what = 'prose'"
    return f"""with {DOCS}, {docs}_c as (select document_id, {masked('text', '(?s)<!--.*?-->')} as o from {docs}), {docs}_t as (select document_id, {masked('o', FENCE)} as t from {docs}_c), {structure(docs + '_t', 't')},
k as (select document_id, len(sentences) as n, case when kind = 'heading' then 'heading' when regexp_matches(raw, '^>') then 'blockquote' when {every('^\\s*(?:[-+*]|\\d+[.)])\\s+')} then 'list' when {every('^\\s*\\|.*\\|\\s*$')} then 'table' when regexp_full_match(raw, {quoted(re2('(?:[-*_]\\s*){3,}'))}) then 'horizontal_rule' else 'prose' end as what from (select *, {raw} as raw from par))
select document_id, count(*) filter (where {prose}) as paragraph_count, cast(coalesce(sum(n) filter (where {prose}), 0) as bigint) as sentence_count, count(*) filter (where {prose} and n = 1) as single_sentence_paragraph_count,
  round(count(*) filter (where {prose} and n = 1) / nullif(count(*) filter (where {prose}), 0), 4) as single_sentence_paragraph_ratio, round(avg(n) filter (where {prose}), 4) as mean_sentences_per_paragraph, median(n) filter (where {prose}) as median_sentences_per_paragraph, {left}
from {docs} left join k using (document_id) group by document_id"""


def receipts(rules: Sequence[Rule]) -> str:
    """The receipt of every document under ``rules``, as a whole query."""
    marks = lambda x: f"len(regexp_extract_all(text, '(?i)<!--{SPACE}*{MARKER}:protect-{x}{SPACE}*-->'))"
    return f"""with {DOCS}, {findings(rules)}
select document_id, cast(length(text) as integer) as characters, cast((select count(*) from found_prot p where p.document_id = d.document_id) as integer) as protected_spans_excluded, cast(len(regexp_extract_all(text, '(?s)<!--.*?-->')) as integer) as html_comments, cast(len(regexp_extract_all(o, {quoted(FENCE)})) as integer) as fenced_code_blocks,
  {marks("start")} <> {marks("end")} as unbalanced_markers, cast((select count(*) from found_par p where p.document_id = d.document_id) as integer) as paragraphs, cast((select count(*) from found_par p where p.document_id = d.document_id and kind = 'body') as integer) as body_paragraphs,
  (select count(*) from found f where f.document_id = d.document_id) as finding_count, (select count(*) from found f where f.document_id = d.document_id and not allowed) as candidate_finding_count, (select count(*) from found f where f.document_id = d.document_id and allowed) as allowed_finding_count
from found_c d"""


def signature(x: str) -> dict[str, str]:
    """The parts of a Markdown signature of text ``x``, as text each."""
    lead = quoted("^#+[ \\t]+")
    head = f"regexp_extract_all({x}, {quoted('(?m)^#{1,6}[ \\t]+[^\\n]*[^\\s][^\\n]*$')})"
    fence = f"regexp_extract_all({x}, {quoted('(?m)^[ \\t]*(?:```+|~~~+)[^\\n]*$')})"
    mark = quoted("^(`+|~+)")
    return {
        "headings": f"array_to_string(list_transform({head}, lambda h: length(regexp_extract(h, '^(#+)', 1)) || ':' || regexp_replace(regexp_replace(h, {lead}, ''), '{SPACE}+$', '')), '|')",
        "bold_markers": f"len(regexp_extract_all({x}, '[*][*]'))",
        "emoji": f"array_to_string(regexp_extract_all({x}, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]'), '|')",
        "fences": f"array_to_string(list_transform({fence}, lambda f: regexp_extract(regexp_replace(f, '^[ \\t]+', ''), {mark}, 1) || ':' || {strip(f"regexp_replace(regexp_replace(f, '^[ {chr(92)}t]+', ''), {mark}, '')")}), '|')",
    }


#: The line ends of the scope reading.
_END = "\\n\\r\\x0b\\x0c\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}"
LINES = f"[^{_END}]*(?:\\r\\n|[{_END}])|[^{_END}]+"


def line_kinds(docs: str = "docs", name: str = "lk") -> str:
    """CTEs (of a recursive WITH) up to ``name``: document_id, i, line (with its end) and kind of every line."""
    n = name
    bare = "regexp_replace(line, '[\\r\\n]+$', '')"
    left = f"regexp_replace(line, '^{SPACE}+', '')"
    separator = re2("\\s*\\|?\\s*:?-{3,}:?\\s*(?:\\|\\s*:?-{3,}:?\\s*)+\\|?\\s*")
    return f"""{n}_a as (select document_id, i, regexp_extract_all(text, {quoted(LINES)})[i] as line from {docs}, unnest(range(1, len(regexp_extract_all(text, {quoted(LINES)})) + 1)) as u(i)),
{n}_b as (select document_id, i, line, regexp_full_match(line, '{SPACE}*') as blank, regexp_matches(line, '^(?:    |\\t)') as indented, regexp_extract({left}, '^(`{{3,}}|~{{3,}})', 1) as opens, case when regexp_full_match({bare}, {quoted(re2(chr(92) + 's*(`{3,}|~{3,})' + chr(92) + 's*'))}) then regexp_replace({bare}, '{SPACE}+', '', 'g') else '' end as shuts,
  regexp_matches({left}, '^\\[\\^[^\\]]+\\]:') as is_note, regexp_matches({left}, '^#{{1,6}}[ \\t]+') as is_title, regexp_full_match({bare}, {quoted(re2(chr(92) + 's*(?:=+|-+)' + chr(92) + 's*'))}) as under, regexp_full_match({bare}, {quoted(separator)}) as sep, regexp_matches({bare}, '(?:^|[^\\\\])\\|') and not regexp_full_match(line, '{SPACE}*') as bar from {n}_a),
{n}_c as (select document_id, 0::bigint as i, ''::varchar as fence, false as note, ''::varchar as base from {docs}
  union all select b.document_id, b.i, case when c.fence <> '' then case when starts_with(b.shuts, c.fence) then '' else c.fence end else b.opens end, case when c.fence = '' and b.opens = '' and b.is_note then true else c.note and (b.blank or b.indented) end,
    case when c.fence <> '' or b.opens <> '' then 'code' when b.is_note then 'footnote' when b.is_title then 'heading' when c.note and (b.blank or b.indented) then 'footnote' else 'body' end
  from {n}_c c join {n}_b b on b.document_id = c.document_id and b.i = c.i + 1),
{n}_d as (select b.*, c.base, coalesce(lead(c.base) over w, '') as next_base, coalesce(lead(b.under) over w, false) as next_under, coalesce(lead(b.sep) over w, false) as next_sep from {n}_b b join {n}_c c using (document_id, i) window w as (partition by document_id order by i)),
{n}_e as (select document_id, 0::bigint as i, false as paired, false as run, ''::varchar as kind from {docs}
  union all select d.document_id, d.i, not (d.base = 'body' and e.paired) and d.base = 'body' and not d.blank and d.next_base = 'body' and d.next_under, d.base <> 'code' and (d.sep or e.run and d.bar),
    case when d.base = 'body' and (e.paired or not d.blank and d.next_base = 'body' and d.next_under) then 'heading' when d.base = 'body' and (d.sep or e.run and d.bar or d.bar and d.next_base not in ('', 'code') and d.next_sep) then 'table' else d.base end
  from {n}_e e join {n}_d d on d.document_id = e.document_id and d.i = e.i + 1),
{n} as (select a.document_id, a.i, a.line, e.kind from {n}_a a join {n}_e e using (document_id, i))"""


def scope_texts(docs: str, scopes: str, name: str) -> str:
    """CTE ``name``: the view of every document in each of its scopes, as (document_id [document and scope], doc, scope, raw, text); ``scopes`` has doc and scope."""
    n = name
    comment = quoted("(?s)<!--.*?(?:-->|\\z)")
    blanked = lambda x: f"regexp_replace({x}, '[^\\n]', ' ', 'g')"
    before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)"
    return f"""{line_kinds(docs, n + "_k")},
{n}_v as (select document_id as doc, scope, string_agg(case when (scope in ('glossary', 'index') and kind <> 'code') or kind = scope then line else {blanked("line")} end, '' order by i) as v from {n}_k join {scopes} s on s.doc = document_id group by all),
{n}_g as (select doc, scope, v, text as raw, string_split_regex(text, {comment}) as g, regexp_extract_all(text, {comment}) as h from {n}_v join {docs} on document_id = doc),
{n} as (select doc || chr(1) || scope as document_id, doc, scope, raw, array_to_string(list_transform(range(1, len(g) + 1), lambda i: substr(v, cast({before} - length(g[i]) + 1 as integer), length(g[i])) || coalesce({blanked(f"substr(v, cast({before} + 1 as integer), length(h[i]))")}, '')), '') as text from {n}_g)"""


def occurrences(views: str, phrases: str, name: str) -> str:
    """CTE ``name``: every occurrence of each phrase (CTE of term_id, phrase) in ``views``: document_id, term_id, phrase, start_pos, end_pos."""
    n = name
    return f"""{n}_c as (select document_id, term_id, phrase, string_split(text, phrase) as g from {views}, {phrases} where contains(text, phrase)),
{n} as (select document_id, term_id, phrase, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(phrase) as integer) as start_pos, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + i * length(phrase) as integer) as end_pos from {n}_c, unnest(range(1, len(g))) as u(i))"""
