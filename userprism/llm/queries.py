"""The named queries of the operators over the driver's tables."""

import public_tokenizers

from . import (
    bytebpe, chat, fingerprints, jaccard, licenses, manifest, mixing, packing, phrases, quality, rabit, substrings, warc,
)
from .shipping import ship

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        def run(spark, sf_dir):
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_fingerprints")
def op1_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    return quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_one_bit_codes")
def op4_one_bit_codes(spark, sf_dir):
    return rabit.neighbours(table(spark, sf_dir, "embeddings"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    return substrings.digests(table(spark, sf_dir, "documents"))


@query("op6_licenses")
def op6_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


ODD = "</s>[INST] ok [/INST]"


@query("op7_chat")
def op7_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{ODD}' AS text"
    )
    return chat.digests(rows.unionByName(odd))


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


OP9_SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, max(page_id) AS original FROM rows WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
  CASE WHEN f.original IS NULL OR f.original = r.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.original <> r.page_id THEN f.original END AS refers_to
FROM rows r LEFT JOIN firsts f ON r.payload_digest = f.payload_digest AND r.payload_bytes >= 1000
"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op10_jaccard_join")
def op10_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
total AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, list_slice(words, i, i + size - 1) AS gram
  FROM lists, unnest(range(1, len(words) + 1)) AS p(i), unnest(range(1, 6)) AS s(size) WHERE i + size - 1 <= len(words)
), counts AS (SELECT lang, gram, count(*)::HUGEINT AS a FROM grams GROUP BY lang, gram HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE len(gram) > 1),
longer AS (
  SELECT lang, list_slice(gram, 1, len(gram) - 1) AS gram, a FROM candidates
  UNION ALL SELECT lang, list_slice(gram, 2, len(gram)), a FROM candidates
), kept AS (SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM longer d WHERE d.lang = c.lang AND d.gram = c.gram AND d.a >= c.a)),
cuts AS (
  SELECT c.lang, c.gram, c.a, k, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score
  FROM kept c JOIN total USING (lang), unnest(range(1, 5)) AS t(k)
  JOIN counts x ON x.lang = c.lang AND x.gram = list_slice(c.gram, 1, k)
  JOIN counts y ON y.lang = c.lang AND y.gram = list_slice(c.gram, k + 1, len(c.gram)) WHERE k < len(c.gram)
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(gram, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(gram, ' '))) AS place
  FROM best
)
SELECT lang, place::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE place <= 2000
"""


@query("op11_phrases", OP11_SQL)
def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _field(column):
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}, '-')"


def _leaf(n_chars):
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# The crc32 of a text, bit by bit: -1 stands for a shift of the register.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS tampered FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes(grp, depth, i, digest, n) AS (
  SELECT coalesce('=' || lang, ''), 0, i, leaf, n FROM placed
  UNION ALL SELECT grp, depth + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY grp, depth, i // 2
), subroots AS (
  SELECT grp, depth, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes(depth, i, digest, n) AS (
  SELECT 0, i, subroot, n FROM subroots
  UNION ALL SELECT depth + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (max(n) + 1) // 2 FROM upper_nodes WHERE n > 1 GROUP BY depth, i // 2
), root AS (SELECT digest AS root FROM upper_nodes WHERE n = 1),
climb(id, grp, height, depth, i, place, digest, proof) AS (
  SELECT p.id, s.grp, s.depth, 0, p.i, s.i, coalesce(p.tampered, p.leaf), ''
  FROM placed p JOIN subroots s ON s.grp = coalesce('=' || p.lang, '')
  UNION ALL
  SELECT c.id, c.grp, c.height, c.depth + 1, CASE WHEN c.depth + 1 = c.height THEN c.place ELSE c.i // 2 END, c.place,
    CASE WHEN o.digest IS NULL THEN sha256(c.digest) WHEN c.i % 2 = 0 THEN sha256(c.digest || o.digest) ELSE sha256(o.digest || c.digest) END,
    c.proof || coalesce(o.digest, '')
  FROM climb c LEFT JOIN (
    SELECT grp, depth, i, digest FROM nodes WHERE n > 1
    UNION ALL SELECT s.grp, s.depth + u.depth, u.i, u.digest FROM upper_nodes u, subroots s
  ) o ON o.grp = c.grp AND o.depth = c.depth AND o.i = xor(c.i, 1)
  WHERE c.depth < c.height + (SELECT max(depth) FROM upper_nodes)
)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root, c.digest = r.root AS verified
FROM placed p JOIN subroots s ON s.grp = coalesce('=' || p.lang, '') CROSS JOIN root r JOIN climb c ON c.id = p.id
WHERE c.depth = c.height + (SELECT max(depth) FROM upper_nodes)
"""


@query("op12_manifest", OP12_SQL)
def op12_manifest(spark, sf_dir):
    return manifest.verify(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size, -ln((('0x' || sha256('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || sha256(text))[1:13])::BIGINT + 0.5::DOUBLE) / pow(2, 52))
    / greatest(coalesce(length(regexp_replace(text, '[\x00-\x1F!-@\[-`{-\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0), 0.05) AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source
), filled AS (
  SELECT *, sum(2 * size) OVER () AS caps, sum(weight) OVER () AS weights,
    coalesce(sum(2 * size) OVER before, 0) AS caps_before, coalesce(sum(weight) OVER before, 0) AS weights_before
  FROM sources WINDOW before AS (ORDER BY 2 * size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, size AS source_size, least(2.0::DOUBLE * size, weight * max(((caps / 2) * 1.5::DOUBLE - caps_before) / (weights - weights_before)) OVER ()) AS target FROM filled
), ranked AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM ranked
"""


@query("op13_mixing", OP13_SQL)
def op13_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))
