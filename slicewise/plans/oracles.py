"""SQL with the results of the registered queries, for a database that reads the same tables.

Bytes are handled as hexadecimal text there: byte k of a text is `substr(h, 2k + 1, 2)`.
"""

from __future__ import annotations

from ..functions.digest import zero_block_md5
from ..functions.patterns import default_tlds
from ..operators.throughput import GB_PER_SPLIT_100_IMAGES
from .queries import ADDRESS_WORD, BUCKET, NEAR, SEED_FILE
from .views import DOCUMENT_BYTES, SLICE, WORD

_TLD = "|".join(sorted(default_tlds(), key=lambda n: (-len(n), n)))
_MAIL = rf"[a-zA-Z0-9][a-zA-Z0-9._%+\-]{{1,64}}@[a-zA-Z0-9._%\-]{{1,64}}\.(?i:{_TLD})"
_BOUNDED = f"({_MAIL})[^a-zA-Z]"
# bytes of an address part: 0x21 to 0x7f but for "(),:;<>@[\]
_VALID = r"[!#-''*+\-./0-9=?A-Z^-\x7f]"
_VALID_SPACE = r"[ !#-''*+\-./0-9=?A-Z^-\x7f]"

_DOCS = "docs AS (SELECT doc_id AS image, text, hex(encode(text)) AS h FROM documents)"


def _chunks(size: int = SLICE, source: str = "docs", image: str = "image") -> str:
    """CTE slices(image, start, len, h) cut from hex text."""
    return f"""slices AS (
        SELECT {image} AS image, k * {size} AS start, substr(h, {2 * size} * k + 1, {2 * size}) AS h
        FROM (SELECT {image}, h, unnest(range(0, CAST(ceil(length(h) / {2.0 * size}) AS BIGINT))) AS k FROM {source}))"""


def _blocks(source: str = "docs", image: str = "image") -> str:
    return f"""blocks AS (
        SELECT {image} AS image, upper(md5(unhex(substr(h, 1024 * k + 1, 1024)))) AS block_md5, k * 512 AS "offset"
        FROM (SELECT {image}, h, unnest(range(0, length(h) // 1024)) AS k FROM {source}))"""


def _found(name: str, source: str, pattern: str, group: int, keep: str = "image") -> str:
    """CTEs that end in name(keep, k, pos, feature): matches with their byte positions.

    Group `group` of the pattern is the feature; what the pattern takes beyond it is a look-ahead.
    """
    return f"""{name}_cuts AS (
        SELECT {keep}, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS f,
               regexp_split_to_array(text, '{pattern}') AS g
        FROM {source} WHERE regexp_matches(text, '{pattern}')),
      {name}_rows AS (SELECT {keep}, unnest(m) AS m, unnest(f) AS feature, unnest(g[1:len(m)]) AS g,
               unnest(range(1, len(m) + 1)) AS k FROM {name}_cuts),
      {name} AS (
        SELECT {keep}, k, feature, CAST(sum(strlen(g)) OVER w + sum(strlen(m)) OVER w - strlen(m) AS BIGINT) AS pos
        FROM {name}_rows WINDOW w AS (PARTITION BY {keep} ORDER BY k))"""


def _mail(source: str = "docs", keep: str = "image") -> str:
    return _found("mail", source, _BOUNDED, 1, keep)


_CONTEXT = """substr(h, 2 * greatest(pos - 16, 0) + 1,
    2 * (least(pos + strlen(feature) + 16, length(h) // 2) - greatest(pos - 16, 0)))"""


def _words() -> str:
    return _found("word", "docs", WORD, 0) + ', words AS (SELECT image, feature AS artifact, pos AS "offset" FROM word)'


def _escape(hex_text: str) -> str:
    """SQL that escapes the bytes given as hexadecimal text."""
    return f"""array_to_string(list_transform(regexp_extract_all({hex_text}, '..'), lambda x:
        CASE WHEN x BETWEEN '20' AND '7E' AND x <> '5C' THEN chr(CAST('0x' || x AS INTEGER)) ELSE chr(92) || 'x' || x END), '')"""


def _anchors(valid: str, docs: str = _DOCS) -> str:
    tld = "upper(string_split(local || '@' || domain, '.')[-1])"
    names = ", ".join(f"'{n}'" for n in default_tlds())
    return f"""{docs},
      cut AS (SELECT image, string_split(text, '@') AS p FROM docs WHERE contains(text, '@')),
      marks AS (SELECT image, p, k, p[k] AS l, p[k + 1] AS r, p[1:k] AS before
             FROM (SELECT image, p, unnest(range(1, len(p))) AS k FROM cut)),
      parts AS (SELECT image, regexp_extract(l, '{valid}*\\z') AS local, regexp_extract(r, '\\A{valid}*') AS domain,
                list_sum(list_transform(before, lambda x: strlen(x))) + k - 1 AS pos FROM marks)
      SELECT image, CAST(pos - length(local) AS BIGINT) AS "offset", local || '@' || domain AS feature
      FROM parts WHERE length(local) BETWEEN 1 AND 64 AND length(domain) BETWEEN 1 AND 256
        AND contains(local || domain, '.') AND {tld} IN ({names})"""


_TOKENS = f"{_DOCS}, {_blocks()}, tokens AS (SELECT DISTINCT image, block_md5 AS token FROM blocks WHERE block_md5 <> '{zero_block_md5()}')"
_SIZES = "sizes AS (SELECT image, count(*) AS tokens FROM tokens GROUP BY image)"
_PAIRS = """pairs AS (SELECT a.image AS image_a, b.image AS image_b, count(*) AS shared
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.image <> b.image GROUP BY ALL)"""

_HIST = f"""{_DOCS}, bytes AS (SELECT image, unnest(regexp_extract_all(h, '..')) AS x FROM docs),
    by_image AS (SELECT image, CAST('0x' || x AS INTEGER) AS byte, count(*) AS n FROM bytes GROUP BY image, x),
    total AS (SELECT byte, CAST(sum(n) AS BIGINT) AS n FROM by_image GROUP BY byte)"""

_ARTIFACTS = """a AS (SELECT user_id AS image, event_type AS artifact, event_id AS "offset" FROM events)"""
_EVENT_CELLS = """cells AS (SELECT concat(event_type, ',', user_id) AS row_key, 'f' AS family,
    CAST(event_id % 16 AS VARCHAR) AS qualifier, lpad(CAST(event_id AS VARCHAR), 12, '0') AS value FROM events)"""
_COUNTS = """o AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1),
    e AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1)"""
_UPSERTED = """WITH o AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1),
    e AS (SELECT user_id AS k, max(event_id) AS v FROM events GROUP BY 1)
    SELECT CAST(coalesce(e.k, o.k) AS VARCHAR) AS row_key, 'f' AS family, 'last' AS qualifier,
    CAST(coalesce(e.v, o.v) AS VARCHAR) AS value FROM o FULL JOIN e ON o.k = e.k"""
# the documents of a source as one medium, each at an offset of its own
_MEDIA = f"""docs AS (SELECT source AS image, doc_id * {DOCUMENT_BYTES} AS base, text, hex(encode(text)) AS h FROM documents)"""
_PAGES = "pagedocs AS (SELECT page_id AS image, html AS text FROM pages)"
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_TASKS = f"""log AS (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t,
    CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'finished' END AS event
    FROM events WHERE event_type IN ('view', 'click')),
  buckets AS (SELECT t // {BUCKET} * {BUCKET} AS bucket, count(*) FILTER (event = 'started') AS started,
    count(*) FILTER (event = 'finished') AS finished FROM log GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "chunk_slices": f"""WITH {_DOCS}, {_chunks()} SELECT image, start AS "offset", h AS data_hex FROM slices""",
    "list_image_sizes": "SELECT doc_id AS image, octet_length(encode(text)) AS length FROM documents",
    "limit_by_bytes": """SELECT image, length FROM (SELECT image, length, sum(length) OVER (ORDER BY image) AS s
        FROM (SELECT doc_id AS image, octet_length(encode(text)) AS length FROM documents)) WHERE s <= 1000000""",
    "limit_first_images": """SELECT CAST(doc_id AS VARCHAR) AS image, octet_length(encode(text)) AS length FROM documents
        WHERE contains(CAST(doc_id AS VARCHAR), '1') AND NOT contains(CAST(doc_id AS VARCHAR), '7') ORDER BY image LIMIT 100""",
    "union_inputs": """SELECT 'document' AS kind, doc_id AS image, octet_length(encode(text)) AS length FROM documents
        UNION ALL SELECT 'page', page_id, octet_length(encode(html)) FROM pages""",
    "split_order": f"""WITH {_DOCS}, {_chunks()} SELECT image, start, length(h) // 2 AS length FROM slices ORDER BY ALL""",
    "progress_log": f"""SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, 'progress' AS event, {_CENTS} AS bytes FROM events""",
    "executor_log": f"WITH {_TASKS} SELECT t, event FROM log",
    "log_line_filter": """SELECT concat(strftime(ts, '%y/%m/%d %H:%M:%S'), ' INFO Executor: Running task ', event_id) AS value
        FROM events WHERE event_type = 'view'""",
    "literal_cells": """SELECT CAST(event_id AS VARCHAR) AS row_key, 'f' AS family, 'a' AS qualifier, event_type AS value FROM events""",
    "escape_text": f"WITH {_DOCS} SELECT image, {_escape('h')} AS escaped FROM docs",
    "latin1_text": f"WITH {_DOCS} SELECT image, length(h) // 2 AS characters, h AS data_hex FROM docs",
    "utf16_narrowed": r"SELECT doc_id, regexp_replace(text, '[^\x{01}-\x{FF}]', '?', 'g') AS narrow FROM documents",
    "raw_files_email": f"""WITH docs AS (SELECT source AS image, doc_id, text || chr(10) AS text FROM documents),
        {_mail("docs", "image, doc_id")} SELECT image AS source, feature, count(*) AS n FROM mail GROUP BY ALL""",
    "raw_files_histogram": """WITH bytes AS (SELECT source, unnest(regexp_extract_all(hex(encode(text || chr(10))), '..')) AS x FROM documents)
        SELECT source, CAST('0x' || x AS INTEGER) AS byte, count(*) AS n FROM bytes GROUP BY source, x""",
    "raw_files_sizes": """SELECT source, n AS listed, n AS whole, n AS sliced FROM
        (SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n FROM documents GROUP BY source)""",
    "raw_image_slices": """SELECT source, n AS bytes, CAST(0 AS BIGINT) AS missing_context FROM
        (SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY source)""",
    "raw_image_tolerant": """SELECT source, n AS bytes, CAST(0 AS BIGINT) AS errors FROM
        (SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY source)""",
    "whole_file_sizes": """SELECT source, n AS length, lines FROM
        (SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY source)""",
    "file_listing": """SELECT source, n AS length FROM
        (SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY source)""",
    "raw_email_scan": f"""WITH docs AS (SELECT source AS image, doc_id, text || chr(10) AS text FROM documents),
        {_mail("docs", "image, doc_id")} SELECT image AS source, count(*) AS n, count(DISTINCT feature) AS addresses FROM mail GROUP BY ALL""",
    "raw_streamed": f"""WITH docs AS (SELECT source AS image, doc_id, text || chr(10) AS text FROM documents),
        {_mail("docs", "image, doc_id")} SELECT image AS source, count(*) AS n, count(DISTINCT feature) AS addresses FROM mail GROUP BY ALL""",
    "raw_unreadable": """SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS errors
        FROM documents GROUP BY source UNION ALL SELECT '', NULL, 1""",
    "slice_table_resumed": """SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes,
        CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS open FROM documents GROUP BY source""",
    "top_level_domains": f"""SELECT page_id, host, contains(host, '.') AND upper(string_split(host, '.')[-1]) IN
        ({", ".join(f"'{n}'" for n in default_tlds())}) AS ok
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages)""",
    "address_parts_valid": f"""SELECT page_id, regexp_full_match(local, '{_VALID}+') AND regexp_full_match(domain, '{_VALID}+')
        AND length(local) <= 64 AND length(domain) <= 256 AS ok
        FROM (SELECT page_id, regexp_extract(url, '^[^/]*/[^/]*/[^/]*/(.*)$', 1, 's') AS local, string_split(url, '/')[3] AS domain
        FROM pages WHERE len(string_split(url, '/')) >= 4)""",
    "offset_shards": f"""WITH {_DOCS}, {_blocks()} SELECT image, "offset" // 4096 AS shard, count(*) AS n FROM blocks GROUP BY ALL""",
    "forensic_paths": """SELECT user_id AS image, event_id AS "offset", concat(user_id, '-', upper(event_type), '-', event_id) AS path FROM events""",
    "nonzero_blocks": f"""WITH {_DOCS}, {_blocks()} SELECT image, count(*) AS n FROM blocks WHERE block_md5 <> '{zero_block_md5()}' GROUP BY 1""",
    "context_windows": f"""WITH {_DOCS}, {_chunks()}, s AS (SELECT *, length(h) // 2 AS n FROM slices)
        SELECT image, start AS "offset", substr(h, 2 * greatest(greatest(n - 8, 0) - 16, 0) + 1) AS context_hex FROM s""",
    "email_scan": f"""WITH {_DOCS}, {_mail("docs", "image, h")} SELECT image, pos AS "offset", feature, {_CONTEXT} AS context_hex FROM mail""",
    "email_scan_seams": f"""WITH {_DOCS}, {_mail()} SELECT image, pos AS "offset", feature FROM mail""",
    "email_scan_resliced": f"""WITH docs AS (SELECT source AS image, doc_id, text || chr(10) AS text FROM documents),
        {_mail("docs", "image, doc_id")} SELECT image, pos + doc_id * 16777216 AS "offset", feature FROM mail""",
    "email_anchor_scan": "WITH " + _anchors(_VALID),
    "email_anchor_scan_spaces": "WITH "
    + _anchors(
        _VALID_SPACE,
        r"docs AS (SELECT doc_id AS image, regexp_replace(text, '(@mail[0-9]+\.[a-z]+\.com)', '\1;', 'g') AS text FROM documents)",
    ),
    "email_scan_utf16": rf"""WITH docs AS (SELECT doc_id AS image, regexp_replace(text, '[^\x{{00}}-\x{{FF}}]', '?', 'g') AS text FROM documents),
        cuts AS (SELECT image, regexp_extract_all(text, '{_BOUNDED}', 0) AS m, regexp_extract_all(text, '{_BOUNDED}', 1) AS f,
            regexp_split_to_array(text, '{_BOUNDED}') AS g FROM docs WHERE regexp_matches(text, '{_BOUNDED}')),
        rows_ AS (SELECT image, m, f, g, unnest(range(1, len(m) + 1)) AS k FROM cuts)
        SELECT image, f[k] AS feature, CAST(2 * (sum(length(g[k])) OVER w + sum(length(m[k])) OVER w - length(m[k])) AS BIGINT) AS "offset"
        FROM rows_ WINDOW w AS (PARTITION BY image ORDER BY k)""",
    "scan_classes": f"""WITH {_DOCS}, {_mail()}, {_words()}
        SELECT 'email' AS artifact_class, image, pos AS "offset", feature FROM mail
        UNION ALL SELECT 'word', image, pos, feature FROM word""",
    "raw_ranges": """SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, true AS even
        FROM documents WHERE starts_with(source, 'src1') GROUP BY source""",
    "email_anchor_scan_utf16": "WITH a AS (SELECT * FROM (WITH "
    + _anchors(_VALID, r"docs AS (SELECT doc_id AS image, regexp_replace(text, '[^\x{00}-\x{7F}]', '?', 'g') AS text FROM documents)")
    + """)) SELECT image, 2 * "offset" AS "offset", feature FROM a""",
    "keyword_scan": f"""WITH {_DOCS}, k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS keyword FROM benchmark),
        hexed AS (SELECT keyword, hex(encode(keyword)) AS x FROM k),
        cut AS (SELECT image, c * 256 AS base, substr(h, 512 * c + 1, 1024) AS h FROM
            (SELECT image, h, unnest(range(0, length(h) // 512 + 1)) AS c FROM docs)),
        places AS (SELECT image, base, h, unnest(range(0, least(256, length(h) // 2))) AS i FROM cut)
        SELECT image, base + i AS "offset", keyword FROM places JOIN hexed ON substr(h, 2 * i + 1, 10) = x[1:10]
        WHERE substr(h, 2 * i + 1, length(x)) = x""",
    "padded_blocks": f"""WITH docs AS (SELECT doc_id AS image, hex(encode(text)) || repeat('00', 1024 - octet_length(encode(text)) % 512) AS h FROM documents), {_blocks()}
        SELECT image, count(*) FILTER (block_md5 <> '{zero_block_md5()}') AS blocks, count(*) FILTER (block_md5 = '{zero_block_md5()}') AS zero
        FROM blocks GROUP BY 1""",
    "unlabelled_contents": """SELECT doc_id AS image FROM documents
        WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))""",
    "seen_across_runs": """WITH r AS (SELECT 0 AS run, text FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT 0, html FROM pages
            UNION ALL SELECT 1, text FROM documents),
        f AS (SELECT text, min(run) AS run FROM r GROUP BY text)
        SELECT run, count(*) AS buffers, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM f GROUP BY run""",
    "image_cosine_pairs": f"""WITH {_DOCS}, {_words()}, tf AS (SELECT image, artifact, count(*) AS tf FROM words GROUP BY ALL),
        df AS (SELECT artifact, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT image) AS n FROM tf),
        w AS (SELECT image, artifact, tf * ln(n / df) AS w FROM tf JOIN df USING (artifact), n WHERE n <> df),
        norms AS (SELECT image, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
        u AS (SELECT image, artifact, w / norm AS w FROM w JOIN norms USING (image))
        SELECT a.image AS image_a, b.image AS image_b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b USING (artifact)
        WHERE a.image < b.image GROUP BY ALL HAVING sum(a.w * b.w) >= 0.5""",
    "block_runs": f"""WITH {_DOCS}, {_blocks()}, b AS (SELECT * FROM blocks WHERE block_md5 <> '{zero_block_md5()}'),
        f AS (SELECT block_md5, min(row(image, "offset")) AS f FROM b GROUP BY 1),
        s AS (SELECT b.image, b."offset" AS o, f.f[1] AS rep, b."offset" - f.f[2] AS diag FROM b JOIN f USING (block_md5)),
        i AS (SELECT *, o - 512 * row_number() OVER (PARTITION BY image, rep, diag ORDER BY o) AS island FROM s WHERE image <> rep OR diag <> 0)
        SELECT image, min(o) AS start, rep AS representative, min(o) - diag AS representative_start, max(o) + 512 - min(o) AS length
        FROM i GROUP BY image, rep, diag, island""",
    "hot_block_hashes": f"""WITH {_DOCS}, {_blocks()} SELECT block_md5, count(*) AS total FROM blocks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "filtered_block_lookup": f"""WITH {_DOCS}, {_blocks()}, t AS (SELECT block_md5, count(*) AS total FROM blocks
        WHERE image IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)
        SELECT block_md5, image, "offset", total FROM blocks JOIN t USING (block_md5)""",
    "media_hops": """WITH e AS (SELECT DISTINCT l_orderkey AS file, l_partkey AS artifact FROM lineitem),
        f0 AS (SELECT min(o_orderkey) AS seed, min(o_orderkey) AS file FROM orders GROUP BY o_orderpriority),
        a1 AS (SELECT DISTINCT seed, artifact FROM f0 JOIN e USING (file)), f1 AS (SELECT DISTINCT seed, file FROM a1 JOIN e USING (artifact)),
        a2 AS (SELECT DISTINCT seed, artifact FROM f1 JOIN e USING (file)), f2 AS (SELECT DISTINCT seed, file FROM a2 JOIN e USING (artifact)),
        f AS (SELECT seed, file, 0 AS hops FROM f0 UNION ALL SELECT seed, file, 1 FROM f1 UNION ALL SELECT seed, file, 2 FROM f2)
        SELECT seed, o_custkey AS media, min(hops) AS hops FROM f JOIN orders ON o_orderkey = file GROUP BY ALL""",
    "long_runs": f"""WITH {_DOCS}, {_words()}, {_found("line", "docs", "[^\\n]+", 0)}
        SELECT 'line' AS artifact_class, image, pos AS "offset", md5(feature) AS md5 FROM line
        UNION ALL SELECT 'word', image, "offset", md5(artifact) FROM words""",
    "artifact_rows": f"""WITH {_DOCS}, {_mail()} SELECT 'email' AS artifact_class, image AS stream_name, '' AS recursion_prefix,
        pos AS "offset", hex(encode(feature)) AS artifact_hex FROM mail""",
    "page_email_scan": f"""WITH docs AS (SELECT page_id AS image, html AS text FROM pages), {_mail()}
        SELECT image, pos AS "offset", feature FROM mail""",
    "embedded_scan": f"""WITH {_DOCS}, {_mail()} SELECT image, '4-GZIP' AS recursion_prefix, pos AS "offset", feature FROM mail""",
    "unseen_buffers": "SELECT doc_id AS image FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM benchmark)",
    "block_hash_table": f"""WITH {_DOCS}, {_blocks()} SELECT image, block_md5, "offset" FROM blocks""",
    "byte_histogram_total": f"WITH {_HIST} SELECT byte, n FROM total",
    "byte_histogram_by_image": f"WITH {_HIST} SELECT CAST(image AS VARCHAR) AS image, byte, n FROM by_image UNION ALL SELECT 'all', byte, n FROM total",
    "byte_histogram_report": f"""WITH {_HIST} SELECT string_agg(concat(i, ' ', coalesce(n, 0), chr(10)), '' ORDER BY i)
        || 'total: ' || CAST(sum(n) AS BIGINT) AS report FROM range(256) r(i) LEFT JOIN total ON byte = i""",
    "byte_histogram_report_one_line": f"""WITH {_HIST} SELECT string_agg(concat(i, ' ', coalesce(n, 0), ' '), '' ORDER BY i)
        || chr(10) || 'total: ' || CAST(sum(n) AS BIGINT) || chr(10) AS report FROM range(256) r(i) LEFT JOIN total ON byte = i""",
    "image_total_bytes": "SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents",
    "read_only": f"WITH {_DOCS}, {_chunks()} SELECT count(*) AS slices, CAST(sum(length(h) // 2) AS BIGINT) AS bytes FROM slices",
    "slice_count": f'WITH {_DOCS}, {_chunks()} SELECT count(*) AS "rows" FROM slices',
    "feature_tsv": f"""WITH {_DOCS}, {_mail("docs", "image, h")} SELECT CAST(image AS VARCHAR) AS image,
        concat(pos, chr(9), feature, chr(9), {_escape(_CONTEXT)}) AS line FROM mail""",
    "artifact_report_lines": f"""WITH {_DOCS}, {_mail("docs", "image, h")}
        SELECT concat('email ', image, ' ', pos, chr(9), feature, chr(9), {_escape(_CONTEXT)}) AS line FROM mail""",
    "cells_address_to_image": f"""WITH {_DOCS}, {_mail()} SELECT feature AS row_key, 'f' AS family, concat(image, ',', pos) AS qualifier, '' AS value FROM mail""",
    "cells_image_to_address": f"""WITH {_DOCS}, {_mail("docs", "image, h")} SELECT concat('email,', image, ',', pos) AS row_key, 'f' AS family,
        feature AS qualifier, {_CONTEXT} AS value FROM mail""",
    "cells_media_to_block": f"""WITH {_DOCS}, {_blocks()} SELECT concat(image, "offset" // 4096) AS row_key, 'f' AS family,
        concat(block_md5, ',', "offset") AS qualifier, '' AS value FROM blocks""",
    "cells_block_to_media": f"""WITH {_DOCS}, {_blocks()} SELECT block_md5 AS row_key, 'f' AS family,
        concat(image, ',', "offset") AS qualifier, '' AS value FROM blocks""",
    "cells_artifacts": f"""WITH {_DOCS}, {_mail()} SELECT concat('email,', image) AS row_key, 'f' AS family,
        CAST(pos AS VARCHAR) AS qualifier, feature AS value FROM mail""",
    "artifacts_per_class": f"""WITH {_DOCS}, {_mail()} SELECT 'email' AS artifact_class, hex(encode(feature)) AS artifact,
        image AS filename, pos AS file_offset, '' AS recursion_path FROM mail""",
    "cells_collapsed": f"WITH {_EVENT_CELLS} SELECT row_key, family, qualifier, max(value) AS value FROM cells GROUP BY ALL",
    "cells_upserted": _UPSERTED,
    "keyed_table": _UPSERTED,
    "compacted_table": _UPSERTED,
    "feature_text_files": f"""WITH {_MEDIA}, {_mail("docs", "image, base, h")}
        SELECT image, concat(base + pos, chr(9), feature, chr(9), {_escape(_CONTEXT)}) AS line FROM mail""",
    "feature_append_files": f"""WITH {_MEDIA}, {_PAGES}, {_mail("docs", "image, base")}, {_found("page_mail", "pagedocs", _BOUNDED, 1)}
        SELECT image, CAST(base + pos AS VARCHAR) AS "offset", feature FROM mail
        UNION ALL SELECT CAST(image AS VARCHAR), CAST(pos AS VARCHAR), feature FROM page_mail""",
    "slice_table": f"""WITH {_MEDIA}
        SELECT image, base + k * {SLICE} AS "offset", md5(unhex(substr(h, {2 * SLICE} * k + 1, {2 * SLICE}))) AS md5
        FROM (SELECT image, base, h, unnest(range(0, CAST(ceil(length(h) / {2.0 * SLICE}) AS BIGINT))) AS k FROM docs)""",
    "artifact_table": f"""WITH {_MEDIA}, {_mail("docs", "image, base")}
        SELECT 'email' AS artifact_class, image AS stream_name, count(*) AS n FROM mail GROUP BY 2
        UNION ALL SELECT 'number', image, CAST(sum(n) AS BIGINT) FROM
        (SELECT image, len(regexp_extract_all(text, '[0-9]{{4,}}')) AS n FROM docs) WHERE n > 0 GROUP BY 2""",
    "streamed_cells": f"""WITH {_MEDIA}, {_PAGES}, {_mail("docs", "image, base")}, {_found("page_mail", "pagedocs", _BOUNDED, 1)}
        SELECT feature AS row_key, 'f' AS family, concat(image, ',', base + pos) AS qualifier, '' AS value FROM mail
        UNION ALL SELECT feature, 'f', concat('page', image, ',', pos), '' FROM page_mail""",
    "cells_filtered": f"""WITH {_EVENT_CELLS} SELECT row_key, family, qualifier, max(value) AS value FROM cells
        WHERE family = 'f' AND qualifier < '5' AND row_key LIKE 'view,%' GROUP BY ALL""",
    "artifact_frequency": f"WITH {_DOCS}, {_words()} SELECT artifact, count(*) AS n FROM words GROUP BY 1",
    "artifact_image_counts": f"WITH {_DOCS}, {_words()} SELECT artifact, image, count(*) AS n FROM words GROUP BY ALL",
    "address_image_counts": f"WITH {_DOCS}, {_mail()} SELECT feature AS artifact, image, count(*) AS n FROM mail GROUP BY ALL",
    "inverted_index": f"""WITH {_ARTIFACTS} SELECT artifact, image, "offset" // 4096 AS part,
        string_agg(DISTINCT "offset", ',' ORDER BY "offset") AS offsets FROM a GROUP BY ALL""",
    "tfidf": f"""WITH {_DOCS}, {_words()}, tf AS (SELECT artifact, image, count(*) AS tf FROM words GROUP BY ALL),
        df AS (SELECT artifact, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT image) AS n FROM words)
        SELECT artifact, image, tf, df, round(tf * ln(n / df), 6) AS tfidf FROM tf JOIN df USING (artifact), n""",
    "hash_sub_counts": f"""WITH docs AS (SELECT source AS image, hex(encode(text)) AS h FROM documents), {_blocks()}
        SELECT block_md5, image AS source, least(count(*), 3) AS sub_count, count(*) > 3 AS clipped FROM blocks GROUP BY block_md5, image""",
    "hash_totals": f"WITH {_DOCS}, {_blocks()} SELECT block_md5, count(*) AS total, count(DISTINCT image) AS sources FROM blocks GROUP BY 1",
    "slowest_slices": """SELECT image, "offset", cost FROM (SELECT user_id AS image, event_id AS "offset", value AS cost,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""",
    "counts_inserted": f"WITH {_COUNTS} SELECT coalesce(o.key, e.key) AS key, coalesce(o.n, 0) + coalesce(e.n, 0) AS n FROM o FULL JOIN e ON o.key = e.key",
    "counts_merged": f"WITH {_COUNTS} SELECT coalesce(o.key, e.key) AS key, coalesce(e.n, o.n) AS n FROM o FULL JOIN e ON o.key = e.key",
    "image_overlap": f"""WITH {_TOKENS}, df AS (SELECT token, count(*) AS df FROM tokens GROUP BY 1)
        SELECT image, count(*) AS tokens, count(*) FILTER (df > 1) AS shared_tokens, CAST(sum(df - 1) AS BIGINT) AS links
        FROM tokens JOIN df USING (token) GROUP BY image""",
    "image_similarity": f"""WITH {_TOKENS}, {_SIZES}, {_PAIRS}
        SELECT image_a, image_b, shared, round(shared / (x.tokens + y.tokens - shared), 6) AS jaccard,
        round(shared / least(x.tokens, y.tokens), 6) AS containment
        FROM pairs JOIN sizes x ON x.image = image_a JOIN sizes y ON y.image = image_b
        WHERE image_a IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "similar_image_pairs": f"""WITH {_TOKENS}, {_SIZES}, {_PAIRS},
        sets AS (SELECT image, list(token ORDER BY token) AS s FROM tokens GROUP BY image),
        reps AS (SELECT min(image) AS image FROM sets GROUP BY s)
        SELECT image_a, image_b, shared, round(shared / (x.tokens + y.tokens - shared), 6) AS jaccard
        FROM pairs JOIN sizes x ON x.image = image_a JOIN sizes y ON y.image = image_b
        WHERE image_a < image_b AND shared / (x.tokens + y.tokens - shared) >= 0.3
        AND image_a IN (SELECT image FROM reps) AND image_b IN (SELECT image FROM reps)""",
    "image_copy_groups": f"""WITH {_TOKENS}, sets AS (SELECT image, list(token ORDER BY token) AS s, count(*) AS tokens FROM tokens GROUP BY image)
        SELECT image, min(image) OVER (PARTITION BY s) AS representative, tokens FROM sets""",
    "shared_artifacts": f"""WITH {_DOCS}, {_words()} SELECT artifact, count(DISTINCT image) AS images, count(*) AS occurrences
        FROM words GROUP BY 1 HAVING count(DISTINCT image) >= 2""",
    "artifact_similarity": f"""WITH {_DOCS}, {_words()}, tokens AS (SELECT DISTINCT image, artifact AS token FROM words)
        SELECT a.image AS image_a, b.image AS image_b, count(*) AS shared FROM tokens a JOIN tokens b USING (token)
        WHERE a.image <> b.image AND a.image IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL""",
    "near_artifacts": f"""WITH {_ARTIFACTS} SELECT x.image, x.artifact AS artifact_a, x."offset" AS offset_a, y.artifact AS artifact_b,
        y."offset" AS offset_b, y."offset" - x."offset" AS distance FROM a x JOIN a y ON x.image = y.image
        AND y."offset" > x."offset" AND y."offset" - x."offset" <= {NEAR}""",
    "adjacent_artifacts": f"""WITH {_ARTIFACTS} SELECT image, artifact, "offset", lag(artifact) OVER w AS prev_artifact,
        lag("offset", 1, -1) OVER w AS prev_offset, lead(artifact) OVER w AS next_artifact, lead("offset", 1, -1) OVER w AS next_offset
        FROM a WINDOW w AS (PARTITION BY image ORDER BY "offset", artifact)""",
    "related_media": f"""SELECT DISTINCT o_custkey AS media FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem
        WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = {SEED_FILE}))""",
    "block_lookup": f"""WITH {_DOCS}, {_blocks()} SELECT image, block_md5, "offset" FROM blocks WHERE block_md5 IN
        (SELECT block_md5 FROM blocks WHERE image IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "address_lookup": f"""WITH {_DOCS}, {_words()} SELECT image, artifact, "offset" FROM words WHERE artifact = '{ADDRESS_WORD}'""",
    "prefiltered_hashes": f"""WITH {_DOCS}, {_blocks()}, totals AS (SELECT block_md5, count(*) AS total FROM blocks GROUP BY 1),
        hot AS (SELECT block_md5 FROM totals ORDER BY total DESC, block_md5 LIMIT 50)
        SELECT image, block_md5, "offset", total, block_md5 IN (SELECT block_md5 FROM hot) AS from_hot FROM blocks JOIN totals USING (block_md5)""",
    "not_ingested_images": """SELECT doc_id AS image, octet_length(encode(text)) AS length FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "neighbour_blocks": f"""WITH {_DOCS}, {_blocks()},
        several AS (SELECT block_md5 FROM blocks GROUP BY 1 HAVING count(DISTINCT image) > 1),
        n AS (SELECT x.block_md5, y.block_md5 AS next_md5, x.block_md5 IN (SELECT block_md5 FROM several) AS block_shared,
        y.block_md5 IN (SELECT block_md5 FROM several) AS next_shared, x.image FROM blocks x JOIN blocks y
        ON x.image = y.image AND y."offset" = x."offset" + 512)
        SELECT block_md5, next_md5, block_shared, next_shared, count(DISTINCT image) AS images, count(*) AS occurrences
        FROM n WHERE block_shared OR next_shared GROUP BY ALL""",
    "top_images": f"""WITH {_DOCS}, {_words()} SELECT image, count(*) AS n FROM words WHERE artifact = '{ADDRESS_WORD}'
        GROUP BY 1 ORDER BY n DESC, image LIMIT 10""",
    "top_images_by_address": f"""WITH {_DOCS}, {_mail()}, best AS (SELECT feature FROM mail GROUP BY 1 ORDER BY count(*) DESC, feature LIMIT 1)
        SELECT image, count(*) AS n FROM mail WHERE feature IN (SELECT feature FROM best) GROUP BY 1 ORDER BY n DESC, image LIMIT 10""",
    "log_counters": f"""SELECT CAST(sum({_CENTS}) FILTER (event_type = 'view') AS BIGINT) AS flex_bytes_considered,
        CAST(sum({_CENTS}) FILTER (event_type <> 'view') AS BIGINT) AS flex_bytes_accepted FROM events""",
    "throughput_series": f"""WITH {_TASKS} SELECT bucket, started, finished,
        round(started * CAST({GB_PER_SPLIT_100_IMAGES / BUCKET!r} AS DOUBLE), 6) AS started_gb_s,
        round(finished * CAST({GB_PER_SPLIT_100_IMAGES / BUCKET!r} AS DOUBLE), 6) AS finished_gb_s FROM buckets ORDER BY bucket""",
    "throughput_cumulative": f"""WITH {_TASKS} SELECT bucket,
        round(sum(started) OVER (ORDER BY bucket) * CAST({GB_PER_SPLIT_100_IMAGES!r} AS DOUBLE), 4) AS started_gb,
        round(sum(finished) OVER (ORDER BY bucket) * CAST({GB_PER_SPLIT_100_IMAGES!r} AS DOUBLE), 4) AS finished_gb FROM buckets""",
    "bytes_cumulative": f"""WITH log AS (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, {_CENTS} AS bytes FROM events),
        s AS (SELECT t, sum(bytes) AS bytes FROM log GROUP BY 1)
        SELECT t - (SELECT min(t) FROM s) AS seconds, CAST(sum(bytes) OVER (ORDER BY t) AS BIGINT) AS total_bytes FROM s""",
    "resharded": f"""WITH {_ARTIFACTS} SELECT artifact, count(*) AS n, CAST(sum("offset") AS BIGINT) AS offsets,
        CAST(16 AS BIGINT) AS files FROM a GROUP BY 1""",
    "saved_artifacts": f"""WITH {_MEDIA}, {_mail("docs", "image, base")}
        SELECT 'email' AS artifact_class, image AS stream_name, count(*) AS n FROM mail GROUP BY 2""",
    "slice_table_names": """WITH n AS (SELECT CAST(doc_id % 100 AS VARCHAR) AS last, octet_length(encode(text)) AS size FROM documents)
        SELECT image, CAST(sum(size) AS BIGINT) AS bytes FROM
        (SELECT unnest([last, lpad(last, 4, '0')]) AS image, size FROM n) GROUP BY 1""",
}
