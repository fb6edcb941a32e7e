"""SQL that gives the same rows as the registered queries."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small(column):
    """Lower-cases A-Z only."""
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def decontamination(documents="documents", benchmark="benchmark"):
    words = f"coalesce(regexp_extract_all({small('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""WITH item AS (SELECT item_id::varchar AS item, {words} AS w FROM {benchmark}),
  iw AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
    FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
  doc AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {documents}),
  ks AS (SELECT DISTINCT k FROM iw),
  dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM doc, ks, unnest(range(1, len(w) - k + 2)) t(i)),
  occ AS (SELECT rid, i, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.p = iw.p),
  hit AS (SELECT rid, count(DISTINCT i + j) AS n FROM occ, unnest(range(0, k)) u(j) GROUP BY rid),
  found AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0)::bigint AS n_hit, coalesce(found.n, 0)::bigint AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)"""


def line_templates(documents="documents", least=6, depth=3, support=3, step=2, fixed=70, min_docs=5):
    """Short lines are leaves of their own. A line's templates go by levels, each asking `step` times as many lines for a token; the
    first level that recurs counts."""
    ws = "[ \\t\\x0B\\f\\r]"
    return f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM {documents}),
  ln AS (SELECT rid, doc_id, text, k AS line_no, string_split_regex(regexp_replace(ls[k], '^{ws}+|{ws}+$', '', 'g'), '{ws}+') AS raw
    FROM doc, unnest(range(1, len(ls) + 1)) u(k)),
  m AS (SELECT *, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END) AS hid FROM ln WHERE raw <> ['']),
  g AS (SELECT rid, doc_id, text, line_no, CASE WHEN len(raw) >= {least} OR 100 * len(list_filter(hid, lambda t: t <> '<*>')) >= {fixed} * len(raw) THEN hid ELSE raw END AS tk FROM m),
  l AS (SELECT rid, doc_id, text, line_no, len(tk) || ' ' || array_to_string(CASE WHEN len(tk) >= {least} THEN tk[1:{depth}] ELSE tk END, ' ') AS leaf,
    tk, array_to_string(tk, ' ') AS sig FROM g),
  d AS (SELECT DISTINCT leaf, sig, tk FROM l),
  o AS (SELECT d.* FROM d JOIN (SELECT leaf FROM d GROUP BY leaf HAVING count(*) >= {support}) USING (leaf)),
  p AS (SELECT leaf, sig, k AS place, tk[k] AS token FROM o, unnest(range(1, len(tk) + 1)) u(k)),
  kn AS (SELECT leaf, place, token, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= {support}),
  w AS (SELECT sig, list({{'token': p.token, 'n': kn.n}} ORDER BY p.place) AS line, max(kn.n) AS most
    FROM p LEFT JOIN kn USING (leaf, place, token) GROUP BY leaf, sig HAVING max(kn.n) IS NOT NULL),
  v AS (SELECT sig, level, list_transform(line, lambda e: CASE WHEN e.n >= {support} * {step} ** level THEN e.token ELSE '<*>' END) AS tk
    FROM w, unnest(range(0, floor(ln(most / {support}) / ln({step}) + 1e-9)::bigint + 1)) u(level)),
  f AS (SELECT sig, 'template ' || array_to_string(tk, ' ') AS template, min(level) AS level FROM v
    WHERE 100 * len(list_filter(tk, lambda t: t <> '<*>')) >= {fixed} * len(tk) GROUP BY 1, 2),
  c AS (SELECT sig, template, level FROM f UNION ALL SELECT DISTINCT sig, 'line ' || sig, 0 FROM l WHERE sig NOT IN (SELECT sig FROM f)),
  r AS (SELECT template FROM (SELECT DISTINCT template, doc_id, text FROM l JOIN c USING (sig)) GROUP BY template HAVING count(*) >= {min_docs}),
  q AS (SELECT sig, arg_min(template, level) AS template FROM c JOIN r USING (template) GROUP BY 1),
  h AS (SELECT rid, doc_id, text, line_no, template FROM l JOIN q USING (sig)),
  low AS (SELECT template, min(doc_id) AS doc_id FROM h GROUP BY 1),
  keep AS (SELECT template, h.doc_id, min(h.line_no) AS line_no FROM low JOIN h USING (template, doc_id) GROUP BY ALL),
  x AS (SELECT rid, list(h.line_no) AS gone FROM h JOIN keep USING (template) WHERE NOT (h.doc_id = keep.doc_id AND h.line_no = keep.line_no) GROUP BY rid)
SELECT doc_id, coalesce(len(ls), 0)::bigint AS lines, coalesce(len(gone), 0)::bigint AS dropped,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text
    ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda k: NOT list_contains(gone, k)), lambda k: ls[k]), chr(10)) END, '')) AS text_sha256
FROM doc LEFT JOIN x USING (rid)"""


def mixing(documents="documents", parts=100, block_chars=32768):
    return f"""WITH RECURSIVE size AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM {documents} GROUP BY 1),
  share AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS k,
    greatest(1, floor({parts} * sqrt(chars / (SELECT greatest(1, sum(chars)) FROM size)::double) + 0.5))::bigint AS w FROM size),
  ws AS (SELECT list(w ORDER BY k) AS w, sum(w)::bigint AS t FROM share),
  edf AS (SELECT 0::bigint AS slot, list_transform(w, lambda x: 0::bigint) AS done, 0::bigint AS pick FROM ws
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda x, i: x + (i = p)::bigint), p FROM (
      SELECT slot, done, list_min(list_transform(
        list_filter(range(1, len(w) + 1), lambda k: done[k] < w[k] AND (done[k] * t) // w[k] <= slot),
        lambda k: (((done[k] + 1) * t + w[k] - 1) // w[k]) * 100000 + k)) % 100000 AS p
      FROM edf, ws WHERE slot < t)),
  turn AS (SELECT share.source, share.w, slot - 1 AS slot, done[pick] - 1 AS turn FROM edf JOIN share ON pick = share.k WHERE slot > 0),
  doc AS (SELECT doc_id, source, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY source
      ORDER BY md5(coalesce(doc_id::varchar, '')), md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
    FROM {documents}),
  b AS (SELECT doc.*, before // {block_chars} AS block FROM doc)
SELECT doc_id, b.source, block, (block // w) * t + turn.slot AS slot, (block // w) * t + (turn * t) // w AS release,
  (block // w) * t + ((turn + 1) * t + w - 1) // w AS due, before % {block_chars} AS place
FROM b CROSS JOIN (SELECT t FROM ws) LEFT JOIN turn ON turn.source IS NOT DISTINCT FROM b.source AND turn.turn = block % turn.w"""


def backoff(documents="documents", alpha=0.4):
    """Trigrams: each word with the two before it, x a b."""
    words = f"coalesce(regexp_extract_all({small('text')}, '[^ \\t\\n\\x0B\\f\\r]+'), [])"
    return f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {documents}),
  pos AS (SELECT rid, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a, CASE WHEN i > 2 THEN w[i - 2] END AS x FROM doc, unnest(range(1, len(w) + 1)) u(i)),
  own1 AS (SELECT rid, b, count(*) AS n FROM pos GROUP BY ALL),
  own2 AS (SELECT rid, a, b, count(*) AS n FROM pos WHERE a IS NOT NULL GROUP BY ALL),
  own3 AS (SELECT rid, x, a, b, count(*) AS n FROM pos WHERE x IS NOT NULL GROUP BY ALL),
  one AS (SELECT rid, b, sum(n) OVER (PARTITION BY b) - n AS n FROM own1),
  two AS (SELECT rid, a, b, sum(n) OVER (PARTITION BY a, b) - n AS n FROM own2),
  three AS (SELECT rid, x, a, b, sum(n) OVER (PARTITION BY x, a, b) - n AS n FROM own3),
  size AS (SELECT sum(len(w)) AS n FROM doc),
  rest AS (SELECT p.rid, least(p.i - 1, 2) AS longest, one.n AS n1, coalesce(two.n, 0) AS n2, coalesce(three.n, 0) AS n3, c1.n AS before1, c2.n AS before2
    FROM pos p JOIN one ON one.rid = p.rid AND one.b = p.b LEFT JOIN two ON two.rid = p.rid AND two.a = p.a AND two.b = p.b
    LEFT JOIN three ON three.rid = p.rid AND three.x = p.x AND three.a = p.a AND three.b = p.b
    LEFT JOIN one c1 ON c1.rid = p.rid AND c1.b = p.a LEFT JOIN two c2 ON c2.rid = p.rid AND c2.a = p.x AND c2.b = p.a),
  part AS (SELECT rid, n3 = 0 AND n2 = 0 AS alone, longest > 0 AS follows,
    CASE WHEN n3 > 0 THEN log10(n3) - log10(before2) WHEN n2 > 0 THEN (longest - 1) * log10({alpha}) + log10(n2) - log10(before1)
      ELSE longest * log10({alpha}) + CASE WHEN n1 > 0 THEN log10(n1) ELSE log10({alpha}) END END AS l FROM rest),
  s AS (SELECT rid, sum(l) AS l, count(*) FILTER (alone) AS alone, count(*) FILTER (alone AND follows) AS back FROM part GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(back, 0)::bigint AS backed_off,
  CASE WHEN len(w) > 0 AND size.n > len(w) THEN round((l - alone * log10(size.n - len(w))) / len(w), 6) END AS score
FROM doc CROSS JOIN size LEFT JOIN s USING (rid)"""


def resampling(documents="documents", benchmark="benchmark", buckets=10000, seed=2024, least=20, percent=10):
    words = f"coalesce(regexp_extract_all({small('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    # CRC-32 by a table of the 256 bytes' remainders, over the bytes of each different word.
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END"
    return f"""WITH RECURSIVE doc AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {documents}),
  item AS (SELECT {words} AS w FROM {benchmark}),
  one AS (SELECT i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: {step}) AS r FROM range(256) t(i)),
  tab AS (SELECT list(r ORDER BY i) AS tab FROM one),
  dw AS (SELECT rid, unnest(w) AS x FROM doc),
  bw AS (SELECT unnest(w) AS x FROM item),
  voc AS (SELECT DISTINCT x FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw)),
  coded AS (SELECT x, xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(1, octet_length(encode(x)) + 1), lambda k: ('0x' || substr(hex(x), (2 * k - 1)::bigint, 2))::bigint)),
      lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295::bigint) % {buckets} AS b FROM voc, tab),
  db AS (SELECT rid, b FROM dw JOIN coded USING (x)),
  s AS (SELECT b, count(*) AS n FROM db GROUP BY 1),
  t AS (SELECT b, count(*) AS n FROM bw JOIN coded USING (x) GROUP BY 1),
  size AS (SELECT (SELECT count(*) FROM dw)::double AS s, (SELECT count(*) FROM bw)::double AS t),
  gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (size.s + {buckets}) / ((s.n + 1)::double * (size.t + {buckets}))))::bigint AS g
    FROM s LEFT JOIN t USING (b), size),
  per AS (SELECT rid, count(*) AS n, sum(g) AS g FROM db JOIN gain USING (b) GROUP BY 1),
  sc AS (SELECT rid, doc_id, coalesce(n, 0)::bigint AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::bigint AS weight,
    ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM doc LEFT JOIN per USING (rid)),
  sco AS (SELECT rid, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296::double)))::bigint AS score FROM sc),
  rk AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) OVER () AS n FROM sco WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {percent} // 100 THEN r END::bigint AS rank FROM sco LEFT JOIN rk USING (rid)"""


def filter_audit(documents="documents", labels="labels"):
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    orders = " JOIN ".join(f"{letters} {c}(l, b)" + ("" if c == "p" else " ON " + " AND ".join(f"{c}.l <> {x}.l" for x in "pqrst"[: "pqrst".index(c)])) for c in "pqrst")
    before = ["0", "p.b", "p.b + q.b", "p.b + q.b + r.b", "p.b + q.b + r.b + s.b"]
    steps = ", ".join(f"{{'step': {k + 1}, 'bit': {c}.b, 'before': {before[k]}}}" for k, c in enumerate("pqrst"))
    return f"""WITH d AS (SELECT doc_id, coalesce(source::varchar, '') AS part, coalesce(text, '') AS t FROM {documents}),
  x AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
  f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits FROM x),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM {labels} GROUP BY 1),
  c AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
  o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, unnest([{steps}]) AS st FROM {orders}),
  z AS (SELECT part, filter_order, st.step AS step, st.bit AS bit, bits & st.bit > 0 AS fails, bits & st.before > 0 AS gone, c.* EXCLUDE (part) FROM c, o),
  r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::bigint AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END)::bigint AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM z GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM r"""


def overlap_join(documents="documents", size=4, least=85):
    """For tables whose ids are unique and known."""
    words = f"coalesce(regexp_extract_all({small('text')}, '[^\\x20\\x09-\\x0D]+'), [])"
    return f"""WITH RECURSIVE doc AS (SELECT doc_id, {words} AS w FROM {documents}),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {size}) - 1], ' ') AS s
    FROM doc, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  shared AS (SELECT s, doc_id FROM sh WHERE s IN (SELECT s FROM sh GROUP BY 1 HAVING count(*) > 1)),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shared a JOIN shared b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {least} * (x.n + y.n - o)),
  reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
  low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id"""
