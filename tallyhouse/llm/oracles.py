"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from .licenses import LEAST, TEMPLATES
from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR, RULES, UNIT

_W = r"[^\x20\x09-\x0D]+"


def warc() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    groups = " || ".join(f"substr({letters}, CAST(((('0x' || substr(x, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31) + 1 AS BIGINT), 1)" for g in range(8) for k in range(4))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner, sha1(h) AS x FROM p)
    SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {groups} AS payload_digest,
        CASE WHEN page_id = owner OR owner IS NULL OR page_id IS NULL AND owner IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
    FROM o"""


def licenses() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    shingles = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
    low = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH t(license, text) AS (VALUES {values}),
    tw AS (SELECT license, regexp_extract_all({low.format('text')}, '{_W}') AS w FROM t),
    ts AS (SELECT license, {shingles} AS s FROM tw),
    tg AS (SELECT license, len(s) AS total, unnest(s) AS g FROM ts),
    dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low.format('text')}, '{_W}') AS w FROM documents),
    dg AS (SELECT r, unnest({shingles}) AS g FROM dw),
    f AS (SELECT r, license, total, count(*) AS found FROM dg JOIN tg USING (g) GROUP BY ALL HAVING count(*) >= {LEAST}::DOUBLE * total)
    SELECT doc_id, license, CAST(found AS INTEGER) AS found_shingles, CAST(total AS INTEGER) AS total_shingles FROM dw LEFT JOIN f USING (r)"""


def quality() -> str:
    ratio = lambda r: f"CASE WHEN {RULES[r][1]} > 0 THEN ({RULES[r][0]} * 1000) // {RULES[r][1]} ELSE 0 END"
    size = lambda v: f"(CASE WHEN {v} > 0 THEN length(ltrim(bin({v}), '0')) ELSE 1 END)"
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {ratio(r)} AS v FROM m" for r in RULES)
    floor = lambda b: f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} - ({b} // 32 - 1) * 32) << ({b} // 32 - 1) END)"
    top = lambda b: f"({floor(f'({b} + 1)')} - 1)"
    same = lambda keys, x, y: " AND ".join([f"{x}.rule = {y}.rule", *[f"{x}.{k} IS NOT DISTINCT FROM {y}.{k}" for k in keys]])
    shrunk = lambda name, own, keys, parent, over: f"""
    {name} AS (SELECT {keys}rule, b, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT {', '.join('g.' + k for k in (keys + 'rule').split(', '))}, p.b, CAST({PRIOR * UNIT} * p.n // p.total AS BIGINT) AS n FROM (SELECT DISTINCT {keys}rule FROM {own}) g
            JOIN (SELECT *, sum(n) OVER (PARTITION BY {''.join(k + ', ' for k in over)}rule) AS total FROM {parent}) p ON {same(over, 'g', 'p')}
        UNION ALL SELECT {keys}rule, b, n * {UNIT} FROM {own}) GROUP BY ALL)"""  # noqa: E731
    quantiles = lambda name, of, keys, percents: f"""
    {name} AS (SELECT *, {top('b50')} + 4 * greatest({top('b95')} - {top('b50')}, {top('b50')} - {floor('b50')} + 1) AS fence FROM (SELECT {keys}rule, {', '.join(f'min(CASE WHEN below * 100 >= total * {q} THEN b END) AS b{q}' for q in percents)} FROM (
        SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY b) AS below, sum(n) OVER (PARTITION BY {keys}rule) AS total FROM {of}) GROUP BY ALL))"""  # noqa: E731
    cuts = ", ".join(f"max(t) FILTER (WHERE rule = '{r}') AS t_{r}" for r in RULES)
    passed = " AND ".join(f"{ratio(r)} <= t_{r}" for r in RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
    win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
    rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
    cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS j FROM rep) GROUP BY r),
    lin AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_W}') GROUP BY r),
    m AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lin.n - lin.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(lin.n, 0) AS BIGINT) AS n_lines, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
        FROM d LEFT JOIN cov USING (r) LEFT JOIN lin USING (r)),
    s AS (SELECT lang, source, rule, greatest({size('v')} - 6, 0) * 32 + (v >> greatest({size('v')} - 6, 0)::INTEGER) AS b FROM ({stacked})),
    o AS (SELECT lang, source, rule, b, count(*) AS n FROM s GROUP BY ALL),
    l AS (SELECT lang, rule, b, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY ALL),
    e AS (SELECT rule, b, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ALL),
    {shrunk('ls', 'l', 'lang, ', 'e', [])}, {shrunk('os', 'o', 'lang, source, ', 'ls', ['lang'])},
    {quantiles('f', 'os', 'lang, source, ', (50, 95))}, {quantiles('g', 'ls', 'lang, ', (50, 95))},
    cut AS (SELECT f.lang, f.source, f.rule, greatest(g.fence // 2, least(f.fence, g.fence * 2)) AS t FROM f JOIN g ON f.rule = g.rule AND f.lang IS NOT DISTINCT FROM g.lang),
    lim AS (SELECT lang, source, {cuts} FROM cut GROUP BY lang, source),
    v AS (SELECT m.*, {passed} AS passed, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept FROM v"""


def mixing() -> str:
    """The operator's arithmetic, in the same order, without its bins."""
    return f"""
    WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS hash, CAST(coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS BIGINT) AS size FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, hash) - 1 AS copy, pow(2.0::DOUBLE, len(ltrim(bin(size), '0')) // 2) AS weight FROM s),
    total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM total),
    w AS (SELECT *, CAST((position - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS lim FROM ranked),
    f AS (SELECT *, lim / w AS fill FROM w),
    g AS (SELECT *, sum(lim) OVER u - lim AS full_, sum(w) OVER () - sum(w) OVER u + w AS open_, CAST(sum(source_size) OVER () AS DOUBLE) AS all_ FROM f WINDOW u AS (ORDER BY fill, position ROWS UNBOUNDED PRECEDING)),
    lev AS (SELECT *, greatest(0.0::DOUBLE, (all_ - full_) / open_) AS level FROM g),
    fix AS (SELECT fill AS ff, position AS fp, level AS fl FROM lev WHERE level <= fill ORDER BY fill, position LIMIT 1),
    target AS (SELECT source, source_size, CASE WHEN ff IS NULL OR (fill, position) < (ff, fp) THEN lim ELSE least(lim, fl * w) END AS target FROM lev LEFT JOIN fix ON true),
    t AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END + 1e-9::DOUBLE) AS BIGINT) AS certain FROM target),
    tl AS (SELECT *, greatest(0.0::DOUBLE, target - certain * source_size::DOUBLE) AS left_ FROM t),
    c AS (SELECT source, weight, CAST(sum(size) AS DOUBLE) AS words FROM k WHERE size > 0 GROUP BY ALL),
    ch AS (SELECT *, sum(words) OVER h - words AS heavier, sum(words * weight) OVER (PARTITION BY source) - sum(words * weight) OVER h + words * weight AS lighter FROM c WINDOW h AS (PARTITION BY source ORDER BY weight DESC)),
    cl AS (SELECT ch.source, weight, tl.source_size, target, certain, left_, (left_ - heavier) / lighter AS level FROM ch JOIN tl ON ch.source IS NOT DISTINCT FROM tl.source),
    cf AS (SELECT *, max(CASE WHEN level * weight < 1 THEN weight END) OVER (PARTITION BY source) AS fw FROM cl),
    cx AS (SELECT *, max(CASE WHEN weight = fw THEN level END) OVER (PARTITION BY source) AS fl FROM cf),
    cp AS (SELECT *, CASE WHEN weight <= fw THEN greatest(0.0::DOUBLE, fl * weight) END AS p FROM cx),
    u AS (SELECT k.*, target, source_size, certain, left_, p / (1.0::DOUBLE - p) AS odds,
        (('0x' || substr(md5(concat_ws(chr(31), '0', coalesce(CAST(doc_id AS VARCHAR), chr(30)), hash, CAST(copy AS VARCHAR))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
        FROM k JOIN cp ON k.source IS NOT DISTINCT FROM cp.source AND k.weight = cp.weight WHERE size > 0),
    x AS (SELECT *, CASE WHEN left_ <= 0 THEN NULL WHEN odds IS NULL THEN 0.0 WHEN odds > 0 THEN (u / (1.0::DOUBLE - u)) / odds END AS key FROM u),
    y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, hash, copy ROWS UNBOUNDED PRECEDING) AS upto FROM x WHERE key IS NOT NULL),
    gap AS (SELECT source, max(left_) - max(CASE WHEN upto <= left_ THEN upto ELSE 0 END) AS gap FROM y GROUP BY 1),
    z AS (SELECT y.*, upto <= left_ AS taken, gap FROM y JOIN gap ON y.source IS NOT DISTINCT FROM gap.source),
    last AS (SELECT *, row_number() OVER (PARTITION BY source, NOT taken AND size < 2 * gap ORDER BY abs(gap - size), key, doc_id NULLS FIRST, hash, copy) = 1 AND NOT taken AND size < 2 * gap AS closing FROM z),
    n AS (SELECT doc_id, source, hash, copy, certain + CASE WHEN taken OR closing THEN 1 ELSE 0 END AS copies FROM last UNION ALL SELECT doc_id, source, hash, copy, certain FROM x WHERE key IS NULL)
    SELECT k.doc_id, k.size, tl.source_size, tl.target, CAST(k.size * coalesce(n.copies, 0) AS BIGINT) AS taken FROM k JOIN tl ON k.source IS NOT DISTINCT FROM tl.source
        LEFT JOIN n ON k.doc_id IS NOT DISTINCT FROM n.doc_id AND k.source IS NOT DISTINCT FROM n.source AND k.hash = n.hash AND k.copy = n.copy"""


def preferences() -> str:
    plain = lambda x: f"replace(coalesce({x}, ''), '<|', '< |')"
    role = "translate(" + plain("x.role") + ", chr(13) || chr(10), '  ')"
    shown = f"('<|im_start|>' || {role} || chr(10) || {plain('x.text')} || '<|im_end|>' || chr(10))"
    render = lambda t: f"array_to_string(list_transform({t}, lambda x: {shown}), '')"
    head = f"13 + length({role})"
    spans = lambda t: f"array_to_string(list_filter(list_transform({t}, lambda x, i: CASE WHEN x.role = 'assistant' THEN (coalesce(list_sum(list_transform({t}[1:i - 1], lambda x: length({shown}))), 0) + {head})::BIGINT::VARCHAR || '-' || (list_sum(list_transform({t}[1:i], lambda x: length({shown}))) - 1)::BIGINT::VARCHAR END), lambda s: s IS NOT NULL), ',')"
    return f"""
    WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
    a AS (SELECT *, list_max(list_transform(t, lambda x, i: CASE WHEN x.role = 'assistant' THEN i END)) AS at, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next FROM c),
    b AS (SELECT a.conv_id, a.t AS chosen, CASE WHEN a.at IS NULL THEN a.t WHEN n.at IS NULL THEN a.t[1:a.at - 1] ELSE list_append(a.t[1:a.at - 1], {{'role': 'assistant', 'text': n.t[n.at].text}}) END AS rejected FROM a JOIN a n ON a.next = n.conv_id),
    d AS (SELECT *, coalesce(list_min(list_transform(generate_series(1, least(len(chosen), len(rejected))), lambda i: CASE WHEN chosen[i].role IS DISTINCT FROM rejected[i].role OR chosen[i].text IS DISTINCT FROM rejected[i].text THEN i END)) - 1, least(len(chosen), len(rejected))) AS n FROM b),
    e AS (SELECT conv_id AS pair_id, CAST(n AS INTEGER) AS n_prompt_turns, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM d)
    SELECT pair_id, n_prompt_turns, {render('p')} AS prompt, {render('c')} AS chosen, {render('r')} AS rejected, {spans('c')} AS chosen_spans, {spans('r')} AS rejected_spans, len(c) = 0 AND len(r) = 0 AS identical FROM e"""


def centroids(k: int = 16, rounds: int = 3) -> str:
    """Every distance, round after round."""
    zip_sum = "list_sum(list_transform(generate_series(1, 64), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT r, vec_id, x, cluster, CAST({zip_sum} AS BIGINT) AS d FROM v CROSS JOIN c{r}),
        a{r} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM d{r} GROUP BY r)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL),
        n{r} AS (SELECT cluster, list(y ORDER BY i) AS c FROM m{r} GROUP BY 1),
        c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (cluster))""")
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT x AS c, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS cluster FROM v WHERE vec_id IS NOT NULL),
    c0 AS MATERIALIZED (SELECT cluster, c FROM s WHERE cluster < {k}), {', '.join(steps)}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every distance between parts and entries, round after round; vectors of one length."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT r, x, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN c{r} USING (p)) GROUP BY r, p)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT p, e, list(y ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (p, e))""")
    return f"""
    WITH w AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM w CROSS JOIN (SELECT unnest(range({parts})) AS p)),
    s AS (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM w WHERE vec_id IS NOT NULL),
    c0 AS MATERIALIZED (SELECT p, e, x AS c FROM v JOIN s USING (r) WHERE e < {entries}), {', '.join(steps)},
    o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN w USING (r) CROSS JOIN h"""


def copies() -> str:
    return r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM n"""
