"""DuckDB SQL for the numbered queries that SQL can express, over the whole tables."""

from __future__ import annotations

from quillstone.llm.decontamination import MATCHED, OVERLAP


def mixing(weights: dict[str, float], seed: int = 7) -> str:
    """Rates, Poisson quantiles from the same hashes, and copies.  Means beyond 500 do not occur in these tables."""
    weight = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in weights.items())

    def uniform(seed_: int, *parts: str) -> str:
        return f"('0x' || left(md5(concat_ws('|', '{seed_}', {', '.join(parts)})), 13))::BIGINT / 4503599627370496.0::DOUBLE"

    return f"""WITH RECURSIVE counts AS (SELECT source, count(*) AS n, CASE source {weight} ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY 1),
rates AS (SELECT source, (w / (SELECT sum(w) FROM counts)) * (SELECT sum(n) FROM counts)::DOUBLE * 1.0::DOUBLE / n AS rate FROM counts),
cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM rates UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf WHERE k < rate + 12 * sqrt(rate) + 39),
drawn AS (SELECT d.*, md5(coalesce(text, '')) AS m, {uniform(seed, "coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))", "'1'")} AS u FROM documents d),
counted AS (SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars, any_value(d.m) AS m, any_value(c.rate) AS rate, count(*)::INTEGER AS n_copies
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND d.u >= c.total GROUP BY d.doc_id),
copies AS (SELECT *, unnest(range(0, n_copies))::INTEGER AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, rate, n_copies, copy, {uniform(seed + 1, "coalesce(doc_id::VARCHAR, '')", "copy::VARCHAR", "m")} AS shuffle_key FROM copies"""


def substring_dedup() -> str:
    """Every window of 50 words, its smallest document, and what is left."""
    return r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
wins AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT key, min(doc_id) AS owner FROM wins GROUP BY 1),
hit AS (SELECT doc_id, i FROM wins JOIN first ON wins.key = first.key WHERE owner < doc_id),
flags AS (SELECT e.doc_id, e.j, e.word, max(CASE WHEN h.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM each e LEFT JOIN hit h ON e.doc_id = h.doc_id AND e.j = h.i),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS body FROM flags GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id"""


def decontamination() -> str:
    """All equal words of documents and items, without seeds: those of one shift are counted in each window of OVERLAP words.

    A window starts at an equal word, or at the last place where one fits.
    """
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT row_number() OVER () AS item_no, item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
bw AS (SELECT item_no, len(w) AS m, least({OVERLAP}, len(w)) AS width, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM b),
same AS (SELECT doc_id, item_no, i - j AS shift, j, width, least(m, n - (i - j)) - width AS last FROM dw JOIN bw ON dw.word = bw.word WHERE least(m, n - (i - j)) - width >= greatest(0, j - i)),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_no, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {OVERLAP - 1} FOLLOWING) AS ahead FROM same),
best AS (SELECT doc_id, item_no, any_value(width) AS width, greatest(coalesce(max(CASE WHEN j <= last THEN least(ahead, width) END), 0), count(CASE WHEN j >= last THEN 1 END)) AS equal FROM counted GROUP BY doc_id, item_no, shift),
found AS (SELECT doc_id, item_id, max(equal) AS equal FROM best JOIN b USING (item_no) WHERE equal * {OVERLAP} >= width * {MATCHED} GROUP BY 1, 2),
docs AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(equal) AS equal FROM found GROUP BY 1)
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items, coalesce(equal, 0)::INTEGER AS max_equal FROM d LEFT JOIN docs ON d.doc_id = docs.doc_id"""


def importance(percent: int, least_words: int, seed: int, n_buckets: int) -> str:
    """CRC-32 of every distinct feature as a fold over its bytes, counts by bucket, gains, and the draw."""
    return rf"""WITH RECURSIVE crc_table(i, c, k) AS (SELECT i::UINTEGER, i::UINTEGER, 0 FROM range(0, 256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
texts AS (SELECT true AS wanted, NULL::BIGINT AS doc_id, row_number() OVER () AS row_no, text FROM benchmark UNION ALL SELECT false, doc_id, row_number() OVER (), text FROM documents),
words AS (SELECT wanted, doc_id, row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (SELECT wanted, row_no, unnest(list_concat(w, [concat_ws(' ', w[i], w[i + 1]) FOR i IN range(1, len(w))], [concat_ws(' ', w[i], w[i + 1], w[i + 2]) FOR i IN range(1, len(w) - 1)])) AS gram FROM words),
named AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM each)),
hashed AS (SELECT gram, (xor(list_reduce([('0x' || h[2 * i - 1:2 * i])::UINTEGER FOR i IN range(1, len(h) // 2 + 1)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) % {n_buckets})::INTEGER AS bucket FROM named, crc),
counts AS (SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM each JOIN hashed USING (gram) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {n_buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {n_buckets})::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT row_no, count(*) AS n, sum(gain)::BIGINT AS weight FROM each JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY 1),
scores AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256(concat('{seed}:', doc_id)), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM words LEFT JOIN weights USING (row_no) WHERE NOT wanted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {least_words}) OVER () AS n_may FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least_words} AND place <= {percent} * n_may // 100 THEN place END AS rank FROM ranked"""
