"""DuckDB SQL for those queries of this package that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op3_url_filter": r"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, row_number() OVER () AS row,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(host, path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        best AS (SELECT row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
               FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY row)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (row)""",
    "op11_phrase_mining": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws WHERE len(w) > 0),
        grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4)) s(k) WHERE i + k - 1 <= len(w)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        parts AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS p, array_to_string(w[j + 1 : k], ' ') AS q FROM c, (VALUES (1), (2), (3)) s(j) WHERE j < k),
        known AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30),
        left_ AS MATERIALIZED (SELECT t.*, f AS l FROM parts t JOIN known x ON x.lang = t.lang AND x.phrase = t.p),
        cuts AS (SELECT t.*, f AS r, (2000000::HUGEINT * a // (l + f))::BIGINT AS score FROM left_ t JOIN known x ON x.lang = t.lang AND x.phrase = t.q),
        scored AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), (score, j)) AS b FROM cuts GROUP BY lang, phrase, a),
        inner_ AS (SELECT c.lang, array_to_string(c.w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 4) s(i), range(2, 4) t(m) WHERE i + m - 1 <= c.k AND m < c.k GROUP BY ALL),
        kept AS (SELECT s.lang, s.phrase, a, b.l AS l, b.r AS r, b.score AS score FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_page FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
               list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5))::INT >> s) & 31) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM d""",
}
