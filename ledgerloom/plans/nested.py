"""Queries over nested JSON documents. A conversation stands for one, and a version of it that is changed in one of six ways for the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import missing
from ledgerloom.functions import text as T
from ledgerloom.operators import nested as N
from ledgerloom.plans.scalars import W, in_list
from ledgerloom.plans.tables import table

#: What each change adds to the number.
ADDED = (0.0, 0.0000001, 0.00001, 0.001, 0.01, 5.0)


def _documents(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    texts = F.transform("turns", lambda x: x["text"])
    return c.withColumns({"k": F.col("conv_id") % 6, "texts": texts, "roles": F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["turn"].alias("turn")))})


def _json(k, number, texts):
    body = F.struct(F.col("conv_id").alias("id"), F.struct(number.alias("value"), F.lit(True).alias("known")).alias("size"), texts.alias("texts"), F.col("roles"))
    return F.to_json(body)


def pairs(s, d):
    docs = _documents(s, d)
    k, texts, number = F.col("k"), F.col("texts"), F.col("conv_id") + F.lit(0.11)
    changed = (
        F.when(k == 0, texts)
        .when(k == 1, F.reverse(texts))
        .when(k == 2, F.array_append(F.transform(texts, lambda x: F.replace(x, F.lit(" "), F.lit("  "))), F.lit("")))
        .when(k == 3, F.transform(texts, lambda x: F.concat(F.replace(x, F.lit("."), F.lit("!")), F.lit(" the"))))
        .when(k == 4, F.transform(texts, lambda x: F.concat(x, F.lit(" could now"))))
        .otherwise(F.slice(texts, 1, 1))
    )
    added = F.element_at(F.array(*map(F.lit, ADDED)), (k + 1).cast("int"))
    return docs.select("conv_id", "k", _json(k, number, texts).alias("a"), _json(k, number + added, changed).alias("b"))


DOCUMENTS = """c AS (SELECT conv_id, conv_id % 6 AS k, list(text ORDER BY turn) AS texts, list({role: role, turn: turn} ORDER BY turn) AS roles, conv_id + 0.11::DOUBLE AS v FROM conversations GROUP BY 1),
x AS (SELECT conv_id, k, roles, v, texts, v + list_extract(CAST([0, 0.0000001, 0.00001, 0.001, 0.01, 5] AS DOUBLE[]), k + 1) AS w, CASE k WHEN 0 THEN texts WHEN 1 THEN list_reverse(texts) WHEN 2 THEN list_append(list_transform(texts, lambda x: replace(x, ' ', '  ')), '')
 WHEN 3 THEN list_transform(texts, lambda x: replace(x, '.', '!') || ' the') WHEN 4 THEN list_transform(texts, lambda x: x || ' could now') ELSE texts[:1] END AS other FROM c),
p AS (SELECT conv_id, k, to_json({id: conv_id, size: {value: v, known: true}, texts: texts, roles: roles}) AS a, to_json({id: conv_id, size: {value: w, known: true}, texts: other, roles: roles}) AS b FROM x)"""
TREE = """SELECT conv_id, fullkey AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'NUMBER' WHEN type = 'VARCHAR' THEN 'STRING' ELSE type END AS kind, atom ->> '$' AS said FROM p, json_tree(p.{})"""


def json_nodes(s, d):
    rows = N.nodes(pairs(s, d), ["conv_id"], "b").rows
    return rows.select("conv_id", "path", "kind", F.when(F.col("kind") == "NUMBER", F.round(F.col("said").cast("double"), 6)).alias("number"), F.when(F.col("kind") == "STRING", F.md5("said")).alias("text"))


NODES = f"""WITH {DOCUMENTS}, t AS ({TREE.format('b')}) SELECT conv_id, path, kind, CASE WHEN kind = 'NUMBER' THEN round(said::DOUBLE, 6) END AS number, CASE WHEN kind = 'STRING' THEN md5(said) END AS text FROM t"""


def json_matches(s, d):
    rows = pairs(s, d)
    found = N.matches(N.nodes(rows, ["conv_id", "k"], "a"), N.nodes(rows, ["conv_id", "k"], "b"))
    return found.groupBy("k").agg(*(F.bool_and(f"{x}_match").alias(f"{x}_match") for x in N.LEVELS))


MATCHES = """SELECT conv_id % 6 AS k, conv_id % 6 = 0 AS strict_match, conv_id % 6 < 2 AS flexible_match, conv_id % 6 < 3 AS very_flexible_match, conv_id % 6 < 4 AS fuzzy_match, conv_id % 6 < 5 AS meaning_match, true AS data_match
 FROM conversations GROUP BY ALL"""


#: What both versions say of data, the same but for every fourth conversation.
NOTES = ("pay 5% of € 1,200.50 from 2020-01-02 for 7 weeks", "pay 6% of € 1,300.50 from 2021-01-02 for 8 weeks")


def json_levels(s, d):
    """Whether each conversation and its changed version are the same at each level, with data of all kinds beside the texts."""
    rows, same, other = pairs(s, d), *map(F.lit, NOTES)
    noted = lambda c, note: F.concat(F.left(c, F.length(c) - 1), F.lit(',"note":"'), note, F.lit('"}'))
    rows = rows.select("conv_id", noted(F.col("a"), same).alias("a"), noted(F.col("b"), F.when(F.col("conv_id") % 4 == 3, other).otherwise(same)).alias("b"))
    return N.matches(N.nodes(rows, ["conv_id"], "a"), N.nodes(rows, ["conv_id"], "b"))


def _listed(each: str, kept: str = "x <> ''") -> str:
    """SQL for the sorted texts of a list, each as said; {} is the list."""
    return f"list_sort(list_transform(list_filter({{}}, lambda x: {kept}), lambda x: {each}))"


def _without(space: str, words, shortest: int) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower(x), '[^{W[1:-1]}\\s]', '{space}', 'g'), '\\s+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({plain}, ' '), lambda w: length(w) >= {shortest} AND NOT list_contains({in_list(words)}, w)), ' ')"


def _data_sql(pattern: str) -> str:
    return f"regexp_extract_all(na, '{pattern}') = regexp_extract_all(nb, '{pattern}')"


TEXT_LEVELS = {
    "flexible": (_listed("regexp_replace(x, '^\\s+|\\s+$', '', 'g')", "true"), 6),
    "very_flexible": (_listed("trim(regexp_replace(x, '\\s+', ' ', 'g'))"), 4),
    "fuzzy": (_listed(_without("", T.FILLER_WORDS, 0)), 2),
    "meaning": (_listed(_without(" ", T.FILLER_WORDS + T.STOP_WORDS, 3)), 1),
}
JSON_LEVELS = f"""WITH {DOCUMENTS}, n AS (SELECT *, '{NOTES[0]}' AS na, CASE WHEN conv_id % 4 = 3 THEN '{NOTES[1]}' ELSE '{NOTES[0]}' END AS nb FROM x)
SELECT conv_id, texts = other AND v = w AND na = nb AS strict_match, {', '.join(f"{sql.replace('{}', 'texts')} = {sql.replace('{}', 'other')} AND round_even(v, {digits}) = round_even(w, {digits}) AND na = nb AS {name}_match" for name, (sql, digits) in TEXT_LEVELS.items())},
 {_data_sql('[0-9]+%')} OR {_data_sql('€ [0-9.,]+')} OR {_data_sql('[0-9]{4}-[0-9]{2}-[0-9]{2}')} AS data_match FROM n"""


def json_differences(s, d):
    rows = pairs(s, d)
    found = N.differences(N.nodes(rows, ["conv_id"], "a"), N.nodes(rows, ["conv_id"], "b"))
    return found.select("conv_id", "no", "path", F.regexp_extract("difference", r"^(\w+)", 1).alias("what"), F.when(F.col("difference").startswith("length"), F.col("difference")).alias("lengths"))


DIFFERENCES = f"""WITH {DOCUMENTS}, a AS ({TREE.format('a')}), b AS ({TREE.format('b')}),
n AS (SELECT conv_id, len(texts) AS a, len(other) AS b FROM x),
f AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.path, b.path) AS path, CASE WHEN coalesce(a.path, b.path) = '$.texts' AND n.a <> n.b THEN 'length' WHEN n.a <> n.b AND coalesce(a.path, b.path) LIKE '$.texts[%' THEN NULL
 WHEN a.kind = 'NUMBER' AND a.said::DOUBLE <> b.said::DOUBLE THEN 'number' WHEN a.kind = 'STRING' AND a.said <> b.said THEN 'text' END AS what, n.a AS la, n.b AS lb
 FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.path = b.path JOIN n ON n.conv_id = coalesce(a.conv_id, b.conv_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS no FROM f WHERE what IS NOT NULL)
SELECT conv_id, CAST(no AS INTEGER) AS no, path, what, CASE WHEN what = 'length' THEN 'length: ' || la || ' / ' || lb END AS lengths FROM r WHERE no <= 5"""


def json_lists(s, d):
    found = N.lists(N.nodes(pairs(s, d), ["conv_id"], "b"))
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("conv_id", "path", "total", "distinct", "repeats", kinds.alias("kinds"))


LISTS = f"""WITH {DOCUMENTS}, e AS (SELECT conv_id, '$.texts' AS path, unnest(other) AS item, 'STRING' AS kind FROM x UNION ALL SELECT conv_id, '$.roles', (r.role || ' ' || r.turn), 'OBJECT' FROM (SELECT conv_id, unnest(roles) AS r FROM x))
SELECT conv_id, path, count(*) AS total, count(DISTINCT item) AS "distinct", count(*) - count(DISTINCT item) AS repeats, any_value(kind) || '=' || count(*) AS kinds FROM e GROUP BY 1, 2"""


def json_clashing_paths(s, d):
    """Two ways to nest the same texts whose paths look alike: a member named a.b, and b within a. Some keys are null."""
    text = F.coalesce("text", F.lit(""))
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by(text, "turn").alias("first"), F.max_by(text, "turn").alias("last"), F.min_by("role", "turn").alias("role"))
    c = c.select("conv_id", F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("k"), F.array("first").alias("first"), F.array("last").alias("last"))
    both = lambda x, y: F.to_json(F.struct(F.col(x).alias("a.b"), F.struct(F.col(y).alias("b")).alias("a")))
    rows = c.select("conv_id", "k", both("first", "last").alias("a"), both("last", "first").alias("b"))
    found = N.differences(N.nodes(rows, ["conv_id", "k"], "a"), N.nodes(rows, ["conv_id", "k"], "b"))
    return found.select("conv_id", "k", "no", "path", F.md5("difference").alias("difference"))


CLASHING = """WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN arg_min(role, turn) END AS k, arg_min(coalesce(text, ''), turn) AS f, arg_max(coalesce(text, ''), turn) AS l FROM conversations GROUP BY 1),
s AS (SELECT conv_id, k, CASE WHEN length(f) > 50 THEN left(f, 50) || '...' ELSE f END AS f, CASE WHEN length(l) > 50 THEN left(l, 50) || '...' ELSE l END AS l FROM c WHERE f <> l)
SELECT conv_id, k, n AS no, '$.a.b[0]' AS path, md5('text: ' || CASE n WHEN 1 THEN l || ' / ' || f ELSE f || ' / ' || l END) AS difference FROM s, (VALUES (1), (2)) v(n)"""


def required_keys(s, d):
    """Conversations as objects of their roles: which roles are missing, and whether all are there."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("role", F.lit(1).alias("n"))))).alias("j"))
    return c.select("conv_id", F.array_join(missing.missing_keys(F.col("j"), ("system", "tool", "user")), ",").alias("missing_keys"), missing.has_keys(F.col("j"), ("user", "assistant")).alias("complete"))


REQUIRED = """SELECT conv_id, concat_ws(',', CASE WHEN NOT bool_or(role = 'system') THEN 'system' END, CASE WHEN NOT bool_or(role = 'tool') THEN 'tool' END, CASE WHEN NOT bool_or(role = 'user') THEN 'user' END) AS missing_keys,
 bool_or(role = 'user') AND bool_or(role = 'assistant') AS complete FROM conversations GROUP BY 1"""


def sanitized_json(s, d):
    """Texts put between quotes as they are, with line breaks, quotes within words and stray backslashes, then mended and read."""
    said = F.translate(T.drop_controls(F.col("text")), "\"\\'", "   ")
    said = F.replace(F.replace(said, F.lit(". "), F.lit("\\q. ")), F.lit("th"), F.lit('t"h'))
    mended = T.sanitized_strings(F.concat(F.lit('["'), said, F.lit('"]')))
    return table(s, d, "documents").select("doc_id", F.md5(F.try_variant_get(F.try_parse_json(mended), "$[0]", "string")).alias("value"))


SANITIZED = r"""SELECT doc_id, md5(replace(replace(translate(regexp_replace(text, '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), '"\''', '   '), '. ', '\q. '), 'th', 't"h')) AS value FROM documents"""


def picked_texts(s, d):
    """Turns as responses of a model: some blocked, some parsed, some in parts."""
    c, k = table(s, d, "conversations"), F.col("turn") % 4
    finish = F.when(F.col("conv_id") % 5 == 0, "SAFETY").when(F.col("conv_id") % 5 == 1, "MAX_TOKENS")
    picked = T.picked_text(finish, F.when(k == 0, F.lit('{"a": 1}')), F.when(k == 1, F.col("text")), F.when(k == 2, F.array(F.col("role"), F.col("text"))))
    return c.select("conv_id", "turn", "role", F.md5("text").alias("of"), F.md5(picked["text"]).alias("picked"), picked["finish"].alias("finish"))


PICKED = """SELECT conv_id, turn, role, md5(text) AS of, md5(CASE WHEN conv_id % 5 = 0 THEN '' WHEN turn % 4 = 0 THEN '{"a": 1}' WHEN turn % 4 = 1 THEN nullif(text, '') WHEN turn % 4 = 2 THEN role || coalesce(text, '') END) AS picked,
 CASE conv_id % 5 WHEN 0 THEN 'SAFETY' WHEN 1 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish FROM conversations"""

QUERIES = {"json_nodes": json_nodes, "json_matches": json_matches, "json_levels": json_levels, "json_differences": json_differences, "json_lists": json_lists, "json_clashing_paths": json_clashing_paths, "required_keys": required_keys, "sanitized_json": sanitized_json, "picked_texts": picked_texts}
ORACLES = {"json_nodes": NODES, "json_matches": MATCHES, "json_levels": JSON_LEVELS, "json_differences": DIFFERENCES, "json_lists": LISTS, "json_clashing_paths": CLASHING, "required_keys": REQUIRED, "sanitized_json": SANITIZED, "picked_texts": PICKED}
