"""DuckDB SQL for the registered queries that SQL can express."""

OP3 = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(h, q, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT p.*, (SELECT h || q FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(h || q) DESC, length(h) DESC LIMIT 1) AS rule FROM p
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best LEFT JOIN r ON rule = h || q
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p),
t AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM t
"""

OP11 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

#: CRC-32 of a column ``x`` of bytes as a list of numbers, from a table of a byte's eight steps.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
BYTES = "list_transform(range(strlen(hex(encode({0}))) // 2), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"


def _merkle() -> str:
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []

    def up(nodes: str, name: str) -> str:
        """Six levels over a table (tree, place, node); a tree that is down to one node stays as it is."""
        steps.append(f"{name}0 AS (SELECT tree, place, node, count(*) OVER (PARTITION BY tree) AS n FROM {nodes})")
        for k in range(1, 7):
            below = f"{name}{k - 1}"
            steps.append(
                f"{name}{k} AS (SELECT tree, place // 16 AS place, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node,"
                f" (any_value(n) + 15) // 16 AS n FROM {below} GROUP BY tree, place // 16)"
            )
            # What stands before and after each node of the level in its run.
            steps.append(
                f"{name}s{k} AS (SELECT tree, place, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,"
                f" coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a, n > 1 AS real FROM {below}"
                f" WINDOW w AS (PARTITION BY tree, place // 16 ORDER BY place))"
            )
        return f"{name}6"

    steps.append(f"crc AS (SELECT {CRC_TABLE} AS steps)")
    steps.append(f"picked AS (SELECT doc_id, x, {CRC} % 5 = 0 AS changed FROM (SELECT doc_id, {BYTES.format('doc_id::VARCHAR')} AS x FROM documents), crc)")
    steps.append(
        f"leaves AS (SELECT d.doc_id, source AS tree, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS place, {leaf('text').replace('doc_id', 'd.doc_id')} AS node,"
        f" CASE WHEN changed THEN {leaf(lower).replace('doc_id', 'd.doc_id')} END AS evidence FROM documents d JOIN picked USING (doc_id))"
    )
    subroots = up("leaves", "d")
    steps.append(f"groups AS (SELECT tree AS source, 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, node FROM {subroots})")
    root = up("groups", "g")
    steps.append(f"f0 AS (SELECT doc_id, tree, place, node AS leaf, coalesce(evidence, node) AS folded, '' AS proof FROM leaves)")
    for k in range(1, 7):
        steps.append(
            f"f{k} AS (SELECT doc_id, f.tree, f.place // 16 AS place, leaf, CASE WHEN real THEN sha256(b || folded || a) ELSE folded END AS folded, proof || b || a AS proof"
            f" FROM f{k - 1} f JOIN ds{k} s ON f.tree IS NOT DISTINCT FROM s.tree AND f.place = s.place)"
        )
    steps.append("h0 AS (SELECT doc_id, g.place, leaf, folded, proof, g.node AS subroot FROM f6 JOIN groups g ON f6.tree IS NOT DISTINCT FROM g.source)")
    for k in range(1, 7):
        steps.append(
            f"h{k} AS (SELECT doc_id, h.place // 16 AS place, leaf, subroot, CASE WHEN real THEN sha256(b || folded || a) ELSE folded END AS folded, proof || b || a AS proof"
            f" FROM h{k - 1} h JOIN gs{k} s ON h.place = s.place)"
        )
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.node AS verified FROM h6, {root} r"
    )


OP13 = f"""
WITH crc AS (SELECT {CRC_TABLE} AS steps),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM documents),
v AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
known AS MATERIALIZED (SELECT word, {BYTES.format("word")} AS x FROM (SELECT word FROM w UNION SELECT word FROM v)),
hashed AS MATERIALIZED (SELECT word, {CRC} % 10000 AS bucket FROM known, crc),
s AS (SELECT bucket, count(*)::DOUBLE AS n FROM w JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS n FROM v JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + 10000) / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
sums AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN sums USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_url_filter": OP3, "op9_warc": OP9, "op11_exact_dedup": OP11, "op12_merkle": _merkle(), "op13_importance": OP13}
