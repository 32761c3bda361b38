"""DuckDB SQL of the registered training-data queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality, token_counts
from .queries import SYMBOL_NOISE

#: A word and a gap between words, as RE2 writes them.
_WORD = r"[^\x20\x09-\x0D]+"


def _op1() -> str:
    # windows by their text; a word goes if one of the last 50 window starts is in a smaller document
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
                      coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
    p AS (SELECT r, o, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d),
    s AS (SELECT r, o, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
    m AS (SELECT h, min(o) AS least FROM s GROUP BY h),
    bad AS (SELECT s.r, s.i FROM s JOIN m USING (h) WHERE m.least < s.o),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM bad),
    lists AS (SELECT r, list(k) AS ks, count(*) AS n FROM gone GROUP BY r)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(
             CASE WHEN ks IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ks, k)] END,
             ' '), '')) AS kept_sha256
    FROM d LEFT JOIN lists USING (r)"""


def _op4() -> str:
    counts = " UNION ALL ".join(
        f"SELECT source, lang, '{n}' AS tokenizer, count(*) AS documents, "
        f"sum(len(regexp_extract_all(t, '{p}')))::BIGINT AS tokens, sum(length(t))::BIGINT AS chars FROM k GROUP BY ALL"
        for n, p in ((t.name, t.pattern) for t in token_counts.TOKENIZERS.values())
    )
    return f"""
    WITH c AS (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
    k AS (SELECT source, lang, coalesce(regexp_replace(text, '{SYMBOL_NOISE}', '', 'g'), '') AS t
          FROM c WHERE NOT coalesce(doc_id > first_id, false)),
    s AS ({counts})
    SELECT * FROM s"""


def _op5() -> str:
    w = "CASE pos % 3 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(mixing.WEIGHTS)) + " END"
    cap = f"{mixing.MAX_REPEATS} * source_size"
    return rf"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
               FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s),
    v AS (SELECT source, source_size, {w} AS w, ({cap})::DOUBLE AS cap FROM o),
    f AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
                 sum(cap) OVER (ORDER BY cap / w, source NULLS LAST) AS cap_upto,
                 sum(w) OVER (ORDER BY cap / w, source NULLS LAST) AS w_upto FROM v),
    levels AS (SELECT (total - (cap_upto - cap)) / (all_w - (w_upto - w)) AS level, cap / w AS ratio FROM f),
    lv AS (SELECT arg_min(level, ratio) FILTER (WHERE level < ratio) AS level FROM levels),
    t AS (SELECT source, source_size, least(cap, coalesce(level, 0) * w)::DOUBLE AS target FROM v, lv),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
    h AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
    run AS (SELECT h.source, h.h, words, sum(words) OVER (PARTITION BY h.source ORDER BY h.h) - words AS below,
                   target - whole * source_size AS budget
            FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
    edge AS (SELECT source, CASE WHEN below + words - budget < budget - below THEN h + 1 ELSE h END AS threshold
             FROM run WHERE below <= budget AND below + words > budget)
    SELECT d.doc_id, d.size, b.source_size, b.target,
           (d.size * (whole + CASE WHEN d.h < coalesce(edge.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
    LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source"""


def _op10() -> str:
    symbols = quality.SYMBOLS.decode()
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, unnest(regexp_extract_all(text, '{_WORD}')) AS word,
                 generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS i FROM d),
    t AS (SELECT r, i, word, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM w
          WINDOW x AS (PARTITION BY r ORDER BY i)),
    g AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM t WHERE c IS NOT NULL),
    rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words
            FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY r),
    wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
    l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{_WORD}') GROUP BY r, line),
    dl AS (SELECT r, sum(n) AS n_lines, sum(n) - count(*) AS n_dup_lines FROM l GROUP BY r),
    m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                 len(regexp_extract_all(text, '[{symbols}]'))::BIGINT AS n_symbols,
                 coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper
          FROM d LEFT JOIN wc USING (r) LEFT JOIN rep USING (r) LEFT JOIN dl USING (r)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_upper > 40 * word_chars
                OR 100 * n_dup_lines > 50 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
    FROM f"""


def _op11() -> str:
    bit = "CASE f WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END"
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM t),
    lb AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                 + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT
                 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
          FROM w LEFT JOIN lb USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
          WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT filter_order, step, f, {bit} AS bit,
                 list_sum([{bit.replace("CASE f", "CASE g")} FOR g IN string_split(substr(filter_order, 1, step - 1), '')])::INT
                 AS earlier
          FROM (SELECT filter_order, step, substr(filter_order, step, 1) AS f
                FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))),
    e AS (SELECT part, filter_order, step, f, n, good, toxic, mask & coalesce(earlier, 0) = 0 AS here,
                 mask & bit <> 0 AS fails, mask = bit AS alone FROM s, c),
    r AS (SELECT part, filter_order, step, f,
                 coalesce(sum(n) FILTER (WHERE here AND NOT fails), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (WHERE here AND fails), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (WHERE NOT here AND fails), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (WHERE here AND fails), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (WHERE here AND fails), 0)::BIGINT AS toxic_lost
          FROM e GROUP BY ALL)
    SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""


def _op12() -> str:
    # crc32 bit by bit over the decimal id; prefixes by the text of all their turns' digests
    bits = "flatten([[(ord(x) >> k) & 1 FOR k IN range(8)] FOR x IN string_split(conv_id::VARCHAR, '')])"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, [b::BIGINT FOR b IN {bits}]), "
        "lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295)"
    )
    return rf"""
    WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS points,
                      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
               FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
    k AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT k.conv_id, 0 AS own, pos, digest, points FROM k JOIN o ON o.conv_id = k.base AND pos <= h
          UNION ALL SELECT k.conv_id, 1, pos, digest, points FROM k JOIN o ON o.conv_id = k.conv_id AND pos > h),
    q AS (SELECT conv_id, points, digest, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM r),
    l AS (SELECT conv_id, list(digest ORDER BY depth) AS digests, count(*) AS len FROM q GROUP BY conv_id),
    p AS (SELECT conv_id, depth, points, md5(array_to_string(digests[1:depth], ',')) AS node, depth = len AS last
          FROM q JOIN l USING (conv_id)
          UNION ALL SELECT conv_id, 0, 0, '', len IS NULL FROM k LEFT JOIN l USING (conv_id)),
    n AS (SELECT node, any_value(depth)::BIGINT AS depth, any_value(points) AS points, min(conv_id) AS conv_id,
                 count(*) AS n_convs,
                 sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
          FROM p GROUP BY node),
    up AS (SELECT DISTINCT a.node AS top, b.node, b.depth - a.depth AS below
           FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
    kids AS (SELECT top AS node, count(*) AS n_children FROM up WHERE below = 1 GROUP BY top),
    sums AS (SELECT up.top AS node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves,
                    sum((n_convs - 1) * points) AS saved
             FROM up JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY up.top)
    SELECT n.conv_id, n.depth, f.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
           n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
    FROM n JOIN sums USING (node) LEFT JOIN kids USING (node)
    LEFT JOIN up ON up.node = n.node AND up.below = 1 LEFT JOIN n f ON f.node = up.top"""


def oracle_queries() -> dict[str, str]:
    return {
        "op1_substring_dedup": _op1(),
        "op4_token_counts": _op4(),
        "op5_mixing": _op5(),
        "op10_quality_rules": _op10(),
        "op11_filter_audit": _op11(),
        "op12_prefix_trie": _op12(),
    }
