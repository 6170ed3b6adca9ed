"""DuckDB SQL for the queries that SQL can state."""

# Base 32 of a SHA-1 digest: five hex digits are four letters.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))


def _crc_table() -> list[int]:
    """The 256 steps of the usual CRC-32 for one byte."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text, null for null."""
    start = "list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(%s, ''), lambda x: CAST(ascii(x) AS BIGINT)))" % text
    steps = "[" + ", ".join(map(str, _crc_table())) + "]"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce({start}, lambda c, b: xor(c >> 8, CAST({steps}[(xor(c, b) & 255) + 1] AS BIGINT))), 4294967295) END"


def _tree(start: str, prefix: str, levels: int) -> str:
    """CTEs from level 0 (tree, pos, node, n) up: each level hashes runs of 16 while a tree has more than one node."""
    out = [f"{prefix}0 AS ({start})"]
    for k in range(levels):
        out.append(f"""{prefix}{k + 1} AS (
  SELECT tree, pos // 16 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node, CAST(ceil(n / 16) AS BIGINT) AS n FROM {prefix}{k} WHERE n > 1 GROUP BY tree, pos // 16, n
  UNION ALL SELECT * FROM {prefix}{k} WHERE n = 1)""")
        out.append(f"""{prefix}side{k} AS (
  SELECT a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {prefix}{k} a JOIN {prefix}{k} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.tree, a.pos)""")
    return ",\n".join(out)


def _folds(start: str, prefix: str, levels: int) -> tuple[str, str]:
    """CTEs that walk rows (tree, pos, proof, now, ...) up through the levels, and the name of the last."""
    out, last = [], start
    for k in range(levels):
        out.append(f"""{prefix}fold{k} AS (
  SELECT f.* REPLACE (CASE WHEN s.l IS NULL THEN f.pos ELSE f.pos // 16 END AS pos, f.proof || coalesce(s.l || s.r, '') AS proof,
    CASE WHEN s.l IS NULL THEN f.now ELSE sha256(s.l || f.now || s.r) END AS now)
  FROM {last} f LEFT JOIN {prefix}side{k} s ON f.tree = s.tree AND f.pos = s.pos)""")
        last = f"{prefix}fold{k}"
    return ",\n".join(out), last


def _merkle(levels: int = 7) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in [*fields, text]) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    below, last = _folds("leaves0", "s", levels)
    above, top = _folds("mid", "r", levels)
    return f"""
WITH raw AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf("text")} AS leaf,
       {leaf(f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {lower} ELSE text END")} AS now FROM documents),
leaves0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof FROM raw),
{_tree("SELECT tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves0", "s", levels)},
{below},
subs AS (SELECT DISTINCT tree, node FROM s{levels}),
ranks AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM subs),
{_tree("SELECT '' AS tree, pos, node, n FROM ranks", "r", levels)},
mid AS (SELECT f.doc_id, f.leaf, k.node AS subroot, f.proof, f.now, '' AS tree, k.pos FROM {last} f JOIN ranks k ON f.tree = k.tree),
{above}
SELECT doc_id, leaf, subroot, (SELECT node FROM r{levels}) AS root, sha256(proof) AS proof_sha256, now AS folded_root,
  now = (SELECT node FROM r{levels}) AS verified FROM {top}"""


def _repair() -> str:
    key = "coalesce('c' || CAST(conv_id AS VARCHAR), '')"
    lot = crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")

    def add(state: str, cost: str, edit: str, lines: str) -> str:
        return "{'c': %s.c + %s, 'x': %s.x || %s, 't': %s.t || %s}" % (state, cost, state, edit, state, lines)

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    both, back = f"{user} || {assistant}", f"{assistant} || {user}"
    more = {  # up to two rows inserted
        "e": "e", "s": "s",
        "u": least("u", add("e", "5", "'I'", user), add("s", "5", "'I'", user), add("a", "5", "'I'", user), add("u", "10", "'II'", back)),
        "a": least("a", add("u", "5", "'I'", assistant), add("e", "10", "'II'", both), add("s", "10", "'II'", both), add("a", "10", "'II'", both))}

    def put(role: str) -> tuple[str, str, str]:
        name = {"u": "'user'", "a": "'assistant'", "s": "role"}[role]
        own = f"initial = '{role}'"
        cost = f"CASE WHEN must THEN 1000000000 WHEN {own} THEN 0 ELSE {'1000000000' if role == 's' else '1'} END + CASE WHEN cut THEN 5 ELSE 0 END"
        return f"({cost})", f"CASE WHEN {own} THEN 'K' ELSE 'R' END", f"chr(10) || CASE WHEN {own} THEN role ELSE {name} END || ':' || text"

    gone = ("2", "'D'", "''")
    step = {"e": add("e", *gone), "s": least(add("s", *gone), add("e", *put("s"))),
            "u": least(add("u", *gone), *[add(x, *put("u")) for x in "esa"]), "a": least(add("a", *gone), add("u", *put("a")))}
    never = "{'c': CAST(1000000000 AS BIGINT), 'x': '', 't': ''}"
    return f"""
WITH RECURSIVE base AS (SELECT conv_id, {key} AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {lot} % 20 AS lot FROM conversations),
hurt AS (SELECT key, turn, copy, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR lot = 3 WHERE lot <> 0),
marked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS r,
    row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS unended,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM hurt),
faults AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS cut, blank OR again AS must,
    lag(initial) OVER (PARTITION BY key ORDER BY r) || initial NOT IN ('su', 'ua', 'au') AS odd FROM marked),
counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n FROM faults GROUP BY key),
dp(key, r, e, s, u, a) AS (
  SELECT key, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'x': '', 't': ''}}, {never}, {never}, {never} FROM counts
  UNION ALL
  SELECT key, r, {step["e"]}, {step["s"]}, {step["u"]}, {step["a"]} FROM (
    SELECT f.key, f.r, f.role, f.text, f.initial, f.must, f.cut, {", ".join(f"{v} AS {k}" for k, v in more.items())}
    FROM dp JOIN faults f ON f.key = dp.key AND f.r = dp.r + 1)),
best AS (SELECT key, {least("e", more["a"])} AS b FROM dp JOIN counts USING (key) WHERE dp.r = counts.n)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.x, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM base) LEFT JOIN counts USING (key) LEFT JOIN best USING (key)"""


SQL = {
    "op12_turn_repair": _repair(),
    "op13_merkle": _merkle(),
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p""",
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
     g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS place FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g""",
}
