"""The same results in DuckDB SQL, for the operators that SQL can express.

The others (byte-pair ids, packing, learned models, windows by token counts, templates) are tested
against plain Python and on held-out rows in ``tests/llm``.
"""

from __future__ import annotations

from areametrics.llm import lattice, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: Least member of the component of every ``id`` in ``nodes``, by the links ``a``, ``b``.
_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS c FROM nodes UNION
SELECT b, c FROM reach JOIN both_ways ON a = id AND c < b),
parts AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

_SUFFIXES = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
bytes AS (SELECT doc_id, p, hex(t[p:p]) AS b FROM d, range(1, 1000000) r(p) WHERE p <= octet_length(t)),
windows AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM (
  SELECT doc_id, p, t[p:p + 99] AS s FROM d, range(1, 1000000) r(p) WHERE p + 99 <= octet_length(t)) w),
flags AS (SELECT b.doc_id, b.p, b.b, coalesce(max(CASE WHEN nth > 1 THEN b.p ELSE NULL END), 0) AS x
FROM bytes b LEFT JOIN windows w USING (doc_id, p) GROUP BY ALL),
cover AS (SELECT doc_id, p, b, p - max(CASE WHEN x > 0 THEN p ELSE -1000 END)
OVER (PARTITION BY doc_id ORDER BY p) < 100 AS gone FROM flags),
runs AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM cover),
found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
count(*) FILTER (gone AND NOT before) AS n_spans,
sha256(unhex(coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
coalesce(n_spans, 0) AS n_spans, coalesce(kept, sha256('')) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id)"""

_MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
'{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM w,
range(1, 1000000) r(i) WHERE i = 1 AND len(ws) > 0 OR i <= len(ws) - 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id
JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY 1, 2, p.n, q.n
HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN parts ON id = w.doc_id"""

_LATTICE = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e
FROM embeddings), links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y
ON x.label = y.label AND x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= {lattice.COSINE}),
nodes AS (SELECT id FROM v), {_COMPONENTS},
n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = id AS kept
FROM parts LEFT JOIN n USING (id)"""


def _count(pattern: str, text: str = "t") -> str:
    return f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"


def _divergence(a: str, b: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    p, q = (f"list_transform({x}, lambda v: v / list_sum({x})::DOUBLE)" for x in (a, b))
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (z[1] + z[2])) ELSE 0 END"
    terms = f"0.5 * ({part.format('z[1]')} + {part.format('z[2]')})"
    return (
        f"CASE WHEN list_sum({a}) = 0 OR coalesce(list_sum({b}), 0) = 0 THEN 0 ELSE sqrt(greatest(0, list_sum("
        f"list_transform(list_zip({p}, {q}), lambda z: {terms})))) END"
    )


def _rules() -> str:
    escaped = [
        "[a-z]", "[A-Z]", "[0-9]", " ", r"[\t\n\v\f\r]", r"[.,;:!?]", r"[''\"\-()]", r"[#*$%&|<>]",
    ]
    classes = [_count(p) for p in escaped]
    rest = f"{_count('[[:ascii:]]')} - ({' + '.join(f'({c})' for c in classes)})"
    classes += [rest, _count("[^[:ascii:]]")]
    listed = ", ".join(
        f"('{lang}', '{w}', {i + 1})" for lang, ws in rules.COMMON_WORDS.items() for i, w in enumerate(ws)
    )
    bins = rules.WORD_BINS
    bare = f"[{'0, ' * (bins - 1)}1]"
    sums = lambda name, n: ", ".join(f"sum({name}[{i + 1}])" for i in range(n))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
  SELECT doc_id, lang, regexp_extract_all(t, '{_WORD}') AS ws FROM d) x),
known(lang, word, bin) AS (VALUES {listed}),
hits AS (SELECT doc_id, coalesce(bin, {bins}) AS bin, count(*) AS n FROM w LEFT JOIN known k
ON k.lang = w.lang AND word = translate(w, '{_UPPER}', '{_LOWER}') GROUP BY ALL),
common AS (SELECT doc_id, list(n ORDER BY i) AS common FROM (SELECT d.doc_id, i, coalesce(h.n, 0) AS n
FROM d CROSS JOIN range(1, {bins + 1}) r(i) LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.bin = i) x GROUP BY 1),
five AS (SELECT doc_id, p, [w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x,
lead(w, 4) OVER x] AS k FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
often AS (SELECT doc_id, p FROM five WHERE k[5] IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM often, range(5) r(j) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id,
unnest(string_split(t, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
size AS (SELECT doc_id, count(*) AS n, sum(length(w))::BIGINT AS c FROM w GROUP BY 1),
base AS (SELECT d.doc_id, lang, coalesce(s.n, 0) AS n_words, coalesce(s.c, 0) AS word_chars,
{_count('[#*$%&|<>]')} AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
coalesce(c.n, 0) AS n_repeat_words, [{', '.join(classes)}] AS classes, common
FROM d LEFT JOIN size s USING (doc_id) LEFT JOIN lines l USING (doc_id)
LEFT JOIN covered c USING (doc_id) JOIN common USING (doc_id)),
judged AS (SELECT *, n_words < {rules.MIN_WORDS}
OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM base),
pooled AS (SELECT lang AS of, [{sums('classes', rules.CLASS_BINS)}] AS rc, [{sums('common', bins)}] AS rw
FROM judged WHERE NOT base_failed GROUP BY lang),
far AS (SELECT j.*, rw, {_divergence('classes', 'rc')} AS cd, {_divergence('common', 'rw')} AS wd,
{_divergence(bare, 'rw')} AS bare FROM judged j LEFT JOIN pooled ON of IS NOT DISTINCT FROM lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, NOT base_failed
AND NOT (word_chars >= {rules.CLASS_MIN_CHARS} AND cd > {rules.CLASS_DISTANCE} * ({rules.CLASS_SHARE}
+ {1 - rules.CLASS_SHARE} * sqrt({rules.CLASS_MIN_CHARS} / CAST(greatest(word_chars, 1) AS DOUBLE))))
AND NOT (n_words >= {rules.WORD_MIN_WORDS} AND wd > {rules.WORD_SHARE} * bare AND coalesce(
common[{bins}] * list_sum(rw)::DOUBLE > rw[{bins}] * n_words::DOUBLE, false)) AS kept FROM far"""


_TOPK = """WITH v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]),
lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e),
lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 10"""


def oracles() -> dict[str, str]:
    return {
        "op1_suffixes": _SUFFIXES, "op4_minhash": _MINHASH, "op8_lattice": _LATTICE,
        "op10_rules": _rules(), "op13_topk": _TOPK,
    }
