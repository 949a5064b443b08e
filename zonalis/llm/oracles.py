"""SQL that gives the same rows as the queries, where SQL can. The others rest on hashes, sketches, codecs or trained models and are tested against brute force."""

from __future__ import annotations

from zonalis.llm import licenses, lloyd, variants
from zonalis.llm.shared import LOWER, UPPER
from zonalis.llm.url_reputation import RULES, SUFFIXES

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to FROM m"""

_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_FITS = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN {_FITS(h, p)} THEN '{h + p}'" for _, h, p in _LONGEST) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {_FITS(h, p)} THEN '{k}'" for k, h, p in _LONGEST) + " END"
_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)


def _shrunk(name: str, child: str, key: str) -> str:
    """A level (with n, bad, prior) with its prior's strength m and the posterior mean."""
    r = f"(SELECT greatest(least(coalesce((sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), 0), 0.5), 0.001) FROM {child})"
    return f"{name}_m AS (SELECT (1 - r) / r AS m FROM (SELECT {r} AS r)), {name} AS (SELECT {key}, n, bad, (bad + (SELECT m FROM {name}_m) * prior) / (n + (SELECT m FROM {name}_m)) AS mean FROM {child})"


URLS = f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_PATTERN}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{_PATTERN}', 2), '') AS path FROM pages),
b AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM u),
d AS (SELECT *, array_to_string(l[-2:], '.') AS two FROM b),
h AS (SELECT page_id, host, path, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE l[-1] END AS suffix, CASE WHEN two IN ({_SUFFIXES}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain FROM d),
known AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
seen AS (SELECT host, suffix, domain, bad FROM h JOIN known ON known.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1), '') AS BIGINT)),
ch AS (SELECT host, suffix, domain, count(*) AS n, sum(bad) AS bad FROM seen GROUP BY ALL), cd AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM ch GROUP BY ALL),
o AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2) AS p FROM ch),
cs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT p FROM o) AS prior FROM cd GROUP BY suffix), {_shrunk("s", "cs", "suffix")},
pd AS (SELECT domain, suffix, cd.n, cd.bad, s.mean AS prior FROM cd JOIN s USING (suffix)), {_shrunk("dm", "pd", "domain")},
ph AS (SELECT host, ch.n, ch.bad, dm.mean AS prior FROM ch JOIN dm USING (domain)), {_shrunk("hm", "ph", "host")},
e AS (SELECT page_id, h.host, path, coalesce(hm.bad, 0) + (SELECT m FROM hm_m) * coalesce(dm.mean, s.mean, (SELECT p FROM o)) AS a, coalesce(hm.n - hm.bad, 0) + (SELECT m FROM hm_m) * (1 - coalesce(dm.mean, s.mean, (SELECT p FROM o))) AS c
  FROM h LEFT JOIN s USING (suffix) LEFT JOIN dm ON dm.domain = h.domain LEFT JOIN hm ON hm.host = h.host),
f AS (SELECT *, a / (a + c) AS rate, 1 - 1 / (9 * a) AS p, 1 - 1 / (9 * c) AS q, 1 / (9 * a) AS u, 1 / (9 * c) AS w FROM e),
g AS (SELECT *, greatest(q * q - 1.645 * 1.645 * w, 1e-9) AS lead FROM f),
r AS (SELECT *, a / c * pow(greatest((p * q - sqrt(greatest(p * p * q * q - lead * (p * p - 1.645 * 1.645 * u), 0))) / lead, 0), 3) AS odds FROM g)
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_VERDICT}, CASE WHEN odds / (1 + odds) > 1.5 * (SELECT p FROM o) THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS bad_rate FROM r"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT p, q FROM both JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS p, doc_id AS q FROM documents UNION SELECT r.p, l.q FROM reach r JOIN link l ON l.p = r.q),
c AS (SELECT p AS doc_id, min(q) AS component_id FROM reach GROUP BY p)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
NEAR = NEAR.replace("both AS", "meet AS").replace("FROM both", "FROM meet")


_APART = lambda a, b: f"list_sum(list_transform(range(1, {lloyd.SIZE} + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
_OWN = lambda c: f"(SELECT vec_id, v, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT vec_id, v, k, {_APART('v', 'c')} AS d FROM kept, {c}) GROUP BY ALL)"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _round(r: int) -> str:
    """Centroids after round r from those of the round before."""
    sums = f"SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM {_OWN(f'c{r - 1}')}, range(1, {lloyd.SIZE} + 1) t(i) GROUP BY k, i"
    return f"c{r} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN (SELECT k, list({_FLOOR} ORDER BY i) AS c FROM ({sums}) GROUP BY k) m USING (k))"


LLOYD = f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {lloyd.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {lloyd.CLUSTERS}),
{", ".join(_round(r) for r in range(1, lloyd.ROUNDS + 1))},
a AS (SELECT vec_id, k, d FROM {_OWN(f"c{lloyd.ROUNDS}")})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{lloyd.ROUNDS} USING (k)"""

_NOTICES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.NOTICES))
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
_GRAM = ", ".join(f"w[i + {k}]" for k in range(1, licenses.GRAM + 1))
_GRAMS = lambda table, key: f"SELECT {key}, i AS pos, concat_ws(' ', {_GRAM}) AS g FROM {table}, range(0, (SELECT max(len(w)) FROM {table})) r(i) WHERE i + {licenses.GRAM} <= len(w)"
LICENSES = f"""WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
said AS (SELECT notice, label, string_split(lower(t), ' ') AS w, list_transform(list_filter(string_split(t, ' '), lambda x: regexp_full_match(x, '[A-Z]+')), lambda x: lower(x)) AS must FROM (VALUES {_NOTICES}) n(notice, label, t)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM docs),
runs AS (SELECT doc_id, pos, concat_ws(' ', {", ".join(["x"] + [f"lead(x, {k}) OVER o" for k in range(1, licenses.GRAM)])}) AS g, count(*) OVER (PARTITION BY doc_id) - pos AS rest FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
places AS ({_GRAMS("said", "notice")}), sizes AS (SELECT notice, greatest(1, CAST(ceil(count(*) / 3) AS INTEGER)) AS least FROM places GROUP BY notice),
votes AS (SELECT doc_id, notice, runs.pos - places.pos AS d, count(*) AS n FROM runs JOIN places USING (g) WHERE rest >= {licenses.GRAM} GROUP BY ALL),
apart AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, notice ORDER BY d) > {licenses.BAND} THEN 1 ELSE 0 END AS new FROM votes),
parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, notice ORDER BY d) AS part FROM apart),
near AS (SELECT doc_id, notice, min(d) AS low, max(d) AS high FROM parts JOIN sizes USING (notice) GROUP BY doc_id, notice, part, least HAVING sum(n) >= least),
lines AS (SELECT near.*, docs.w AS t, said.w AS w, label, must, unnest(range(low, high + 1)) AS d FROM near JOIN docs USING (doc_id) JOIN said USING (notice)),
held AS (SELECT doc_id, notice, low, label, len(w) AS size, must, d, list_filter(w, lambda x, p: list_contains(t[greatest(d + p, 1) : d + p + {licenses.BAND}], x)) AS got FROM lines),
best AS (SELECT doc_id, label, arg_min(struct_pack(got := got, must := must, share := len(got) / size), (size - len(got)) * 1000000 + d - low) AS b FROM held GROUP BY doc_id, notice, low, label),
spans AS (SELECT doc_id, label, b.share AS share FROM best WHERE b.share > {licenses.SHARE} AND len(list_filter(b.must, lambda x: NOT list_contains(b.got, x))) = 0),
base AS (SELECT doc_id, r.pos, p.label FROM (SELECT doc_id, pos, x || ' ' || lead(x) OVER o AS two, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS three FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) r JOIN (VALUES {_PHRASES}) p(t, label) ON p.t = r.two OR p.t = r.three),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0 AS share FROM base UNION ALL SELECT * FROM spans) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)"""

_CRC = "xor(4294967295, list_reduce(list_transform(range(0, strlen(t)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(list_extract(codes, (xor(c, b) & 255) + 1), c >> 8), 4294967295))"
VARIANTS = f"""WITH RECURSIVE table_of AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS codes FROM range(0, 256) r(n)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
counts AS (SELECT doc_id, w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS t FROM runs GROUP BY doc_id, w),
summed AS (SELECT w, n, {_CRC} AS crc FROM (SELECT *, hex(encode(t)) AS x FROM counts), table_of),
made AS (SELECT n, CASE WHEN crc % {variants.DAMAGED} = 0 THEN left(w, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word FROM summed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}),
cut AS (SELECT word, n, left(word, i) || substr(word, i + 2) AS rest, left(word, i) || '*' || substr(word, i + 2) AS mask FROM v, range(0, (SELECT max(length(word)) FROM v)) r(i) WHERE i < length(word)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.mask = b.mask AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word), named AS (SELECT word, n_near, m, min(near) AS near FROM best JOIN pairs USING (word, m) GROUP BY ALL),
led AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {variants.TIMES} * n THEN near END AS form, CASE WHEN m >= {variants.TIMES} * n THEN m END AS form_n FROM v LEFT JOIN named USING (word)),
follow AS (SELECT word, word AS pos FROM led UNION ALL SELECT f.word, l.form FROM follow f JOIN led l ON l.word = f.pos WHERE l.form IS NOT NULL)
SELECT led.word, form, f.pos AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM led JOIN (SELECT word, pos FROM follow WHERE pos IN (SELECT word FROM led WHERE form IS NULL)) f USING (word)"""

ORACLE_SQL = {"op1_warc_revisits": WARC, "op3_url_reputation": URLS, "op4_near_duplicates": NEAR, "op11_lloyd": LLOYD, "op12_license_scan": LICENSES, "op13_spelling_variants": VARIANTS}
