"""Stand-in gazette corpus over the given tables.

One SQL text per table, written in the subset that Spark SQL and the checking engine share, so both sides
read exactly the same rows. Every projection covers its whole source table; the modulus expressions only
spread values (missing fields, broken scans, foreign organs) over the rows.

* ``gz_editions``  one row per day on which an order was placed or a line shipped
* ``gz_acts``      one act per order (organ from the customer's nation, money from the price)
* ``gz_pages``     one multi-line gazette page per order
* ``gz_mentions``  one mention per order line, in the edition of its ship date
* ``gz_jobs``      one job step per event
* ``gz_responses`` one enrichment answer (JSON text) per order
* ``gz_metrics``   detection counters per edition with acts
* ``gz_words`` / ``gz_blocks``  scanned words and layout blocks from the order lines
* ``gz_files``     stored files of the editions
"""

from __future__ import annotations

from ..config import DetectionConfig

CONFIG = DetectionConfig(
    target="NATION_5",
    tax_ids=("11.222.333/0001-81", "44.555.666/0001-77"),
    postal_prefixes=("87670",),
    neighbours=("NATION_0", "NATION_10", "NATION_15", "NATION_20"),
    scan_variants=(r"NAT\s*ION_5", r"NATIQN_5"),
    truncated_stem="NAT",
    named_persons=("joao silva",),
)
AS_OF_DAY = "2001-09-01"
AS_OF_YEAR = 2001
AS_OF_TS = "2024-01-30 12:00:00"

_BASE = """
SELECT o.o_orderkey AS k, o.o_custkey AS cust, CAST(o.o_orderdate AS DATE) AS d,
  o.o_orderpriority AS prio, o.o_orderstatus AS st, c.c_name AS cname, c.c_mktsegment AS seg,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'NATION_5' ELSE n.n_name END AS place,
  (o.o_orderkey * 7919 + o.o_custkey * 31) % 997 AS h,
  CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

_FIELDS = """
SELECT b.*, CAST(year(d) AS BIGINT) * 10000 + month(d) * 100 + day(d) AS edition_id, CAST(d AS STRING) AS ds,
  CASE WHEN prio = '1-URGENT' THEN 'Dispensa'
       WHEN prio = '2-HIGH' THEN 'Extrato de Contrato'
       WHEN prio = '3-MEDIUM' THEN CASE k % 3 WHEN 0 THEN 'Termo Aditivo' WHEN 1 THEN 'CONTRATO ADMINISTRATIVO' ELSE 'Pregão Eletrônico' END
       WHEN prio = '4-NOT SPECIFIED' THEN CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Outros' WHEN 2 THEN 'ato administrativo' WHEN 3 THEN 'Portaria' ELSE 'Termo de Homologação' END
       ELSE CASE k % 5 WHEN 0 THEN 'DECRETO' WHEN 1 THEN 'LEI' WHEN 2 THEN 'Relatório de Gestão Fiscal' WHEN 3 THEN 'Balanço Anual' ELSE 'Edital' END
  END AS act_type,
  CASE h % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Câmara Municipal de ' || place WHEN 2 THEN 'Município de ' || place
       WHEN 3 THEN 'Conselho Municipal de Saúde' WHEN 4 THEN '' ELSE 'Prefeitura Municipal de ' || place END AS organ,
  CASE h % 13 WHEN 0 THEN NULL WHEN 1 THEN '16132720'
       WHEN 2 THEN lpad(CAST(k % 100 AS STRING), 3, '0') || CAST(year(d) AS STRING)
       WHEN 3 THEN CAST(k % 500 AS STRING)
       WHEN 4 THEN lpad(CAST(k % 100 AS STRING), 3, '0') || '/' || CAST(year(d) + 10 AS STRING)
       WHEN 5 THEN lpad(CAST(k % 100 AS STRING), 3, '0') || '/' || CAST(year(d) + 40 AS STRING)
       ELSE lpad(CAST(k % 100 AS STRING), 3, '0') || '/' || CAST(year(d) AS STRING) END AS number,
  CASE h % 6 WHEN 0 THEN NULL
       WHEN 1 THEN CAST(day(d) AS STRING) || ' de ' ||
         CASE month(d) WHEN 1 THEN 'janeiro' WHEN 2 THEN 'fevereiro' WHEN 3 THEN 'março' WHEN 4 THEN 'abril'
           WHEN 5 THEN 'maio' WHEN 6 THEN 'junho' WHEN 7 THEN 'julho' WHEN 8 THEN 'agosto' WHEN 9 THEN 'setembro'
           WHEN 10 THEN 'outubro' WHEN 11 THEN 'novembro' ELSE 'dezembro' END || ' de ' || CAST(year(d) AS STRING)
       WHEN 2 THEN lpad(CAST(day(d) AS STRING), 2, '0') || '/' || lpad(CAST(month(d) AS STRING), 2, '0') || '/' || CAST(year(d) AS STRING)
       WHEN 3 THEN CAST(day(d) AS STRING) || '-' || CAST(month(d) AS STRING) || '-' || lpad(CAST(year(d) % 100 AS STRING), 2, '0')
       WHEN 4 THEN lpad(CAST(day(d) AS STRING), 2, '0') || '/' || lpad(CAST(month(d) AS STRING), 2, '0') || '/' || CAST(year(d) - 30 AS STRING)
       ELSE lpad(CAST(day(d) AS STRING), 2, '0') || '/' || lpad(CAST(month(d) AS STRING), 2, '0') || '/' || CAST(year(d) AS STRING) END AS doc_date,
  CASE WHEN cents >= 100000 THEN CAST(CAST(floor(cents / 100000) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0')
       ELSE CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) END || ',' || lpad(CAST(cents % 100 AS STRING), 2, '0') AS money
FROM {base} b
"""

_TITLES = """
SELECT f.*,
  CASE h % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'R S ' || money WHEN 3 THEN 'no valor de R$ ' || money
       ELSE 'R$ ' || money END AS value,
  coalesce(CASE WHEN h % 17 = 1 AND act_type = 'LEI' THEN 'LEIN°' WHEN h % 17 = 2 THEN 'RATO DO CONTRATO Nº'
       WHEN act_type = 'LEI' THEN 'LEI Nº' ELSE upper(act_type) || CASE WHEN h % 5 = 0 THEN ' ' ELSE ' Nº ' END END, 'Comunicado') AS title_head,
  CASE h % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Aquisição de veículo para a secretaria de ' || lower(seg)
       WHEN 2 THEN 'Contratação de serviços de asfalto e obra - ' || cname ELSE 'Nomeação de servidor ' || lower(seg) END AS subject
FROM {fields} f
"""

ACTS = """
SELECT k AS act_id, edition_id, CAST(1 + h % 12 AS INT) AS page, CAST(1 + k % 7 AS INT) AS block,
  CASE WHEN st = 'P' AND h % 3 = 0 THEN 'materia_jornalistica' ELSE 'publicacao_oficial' END AS category,
  organ, act_type, number, doc_date, subject, value,
  coalesce(organ, 'Aviso') || chr(10) || title_head || coalesce(number, '') || chr(10) || coalesce(subject, '') ||
    ' no valor de R$ ' || money || CASE WHEN h % 8 = 0 THEN ' nos termos da lei n 8666, processo n 12/' || CAST(k % 50 AS STRING) ELSE '' END ||
    CASE WHEN h % 3 = 0 THEN ' para o fornecimento de combustível, litro a litro, com entrega mensal na sede do município e fiscalização da secretaria' ELSE '' END AS excerpt,
  CASE h % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Resumo: ' || coalesce(act_type, 'ato') || ' ' || coalesce(number, '') || ' de ' || place || ' por R$ ' || money
       ELSE CASE WHEN k % 10 = 0 THEN '' ELSE 'Ato de ' || lower(seg) || ' em ' || place END END AS summary,
  CASE WHEN h % 9 = 0 THEN 'correto' WHEN h % 9 = 1 THEN 'errado' WHEN h % 9 = 2 THEN '' ELSE NULL END AS feedback,
  CAST(CASE WHEN h % 8 = 7 THEN NULL ELSE h % 6 END AS INT) AS importance,
  CASE WHEN h % 5 = 0 THEN NULL ELSE CAST(h % 2 AS INT) END AS notify,
  CASE h % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'licitacao, obra' WHEN 3 THEN 'Saúde,rh, saúde' ELSE 'fiscal' END AS themes,
  CASE h % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{"ok": false, "flags": [{{"campo": "valor"}}]}}' WHEN 2 THEN '{{"ok": true, "avisos": ["x"]}}'
       WHEN 3 THEN 'not json' ELSE '{{"ok": true, "flags": []}}' END AS validation,
  CASE h % 7 WHEN 0 THEN '["numero_corrigido:x"]' WHEN 1 THEN '' WHEN 2 THEN '"leve"' WHEN 3 THEN 'texto solto' WHEN 4 THEN '["a","b"]' ELSE NULL END AS flags,
  CAST(CASE WHEN h % 10 = 0 THEN 1 ELSE 0 END AS INT) AS anomaly,
  CASE WHEN h % 10 = 0 THEN CASE WHEN h % 4 < 2 THEN 'valor alto' ELSE 'outra razao' END END AS anomaly_reason,
  CAST(CASE WHEN h % 3 = 1 THEN 1 ELSE 0 END AS INT) AS enriched,
  CAST(h % 4 AS INT) AS attempts, CASE h % 5 WHEN 0 THEN 'esgotado' WHEN 1 THEN 'ok' WHEN 2 THEN 'pendente' ELSE NULL END AS enrich_status,
  CAST(h % 101 AS INT) AS confidence,
  CASE WHEN h % 101 >= 85 THEN 'alta' WHEN h % 101 >= 55 THEN 'media' WHEN h % 101 < 5 THEN NULL ELSE 'revisar' END AS confidence_level,
  ds AS created_day
FROM {titles} t
"""

PAGES = """
SELECT edition_id, CAST(k AS INT) AS page, CASE h % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'pdfplumber' WHEN 2 THEN 'ocr-hq' ELSE 'texto' END AS method,
  CASE h % 10 WHEN 0 THEN 'PREFEITURA MUNICIPAL DE ' || place || chr(10) WHEN 1 THEN 'CÂMARA MUNICIPAL DE ' || place || chr(10)
    WHEN 2 THEN 'MUNICÍPIO DE ' || place || chr(10) WHEN 3 THEN '' WHEN 4 THEN 'PREFEITURA MUNICIPAL DE NAT' || chr(10)
    WHEN 5 THEN 'Conselho Municipal de Saúde' || chr(10) WHEN 6 THEN 'Distribuição avulsa: Auto Posto ' || place || chr(10)
    WHEN 7 THEN 'A cidade de ' || place || ' recebeu a equipe de futebol' || chr(10)
    WHEN 8 THEN 'Combustível SR 10 Marca: ' || place || chr(10) ELSE 'Prefeitura Municipal de NAT ION_5' || chr(10) END ||
  CASE WHEN h % 23 = 7 THEN 'Art. 5 fica mantido' || chr(10) ELSE '' END ||
  CASE h % 10 WHEN 7 THEN 'Domingo de sol e festa' ELSE title_head || coalesce(number, '') END || chr(10) ||
  CASE h % 3 WHEN 0 THEN 'SÚMULA: ' || coalesce(subject, 'Dispõe') || chr(10) WHEN 1 THEN coalesce(subject, 'Dá outras providências') || chr(10) ELSE '' END ||
  CASE WHEN h % 9 = 0 THEN 'CNPJ 11.222.333/0001-81' || chr(10) ELSE '' END ||
  CASE WHEN h % 8 = 0 THEN 'CEP 87.670-000' || chr(10) WHEN h % 8 = 1 THEN 'CEP 87.111-000' || chr(10) ELSE '' END ||
  'O Prefeito, no uso de suas atribuições, publica ' || lower(seg) || ' ' || cname || ' no valor de R$ ' || money || chr(10) ||
  CASE WHEN h % 6 = 0 THEN 'PORTARIA Nº ' || CAST(k % 90 AS STRING) || '/' || CAST(year(d) AS STRING) || chr(10) ELSE '' END ||
  CASE WHEN h % 2 = 0 THEN repeat('Fica aprovado o repasse mensal para ' || cname || ' na forma da legislação em vigor e do plano plurianual.' || chr(10), 5) ELSE '' END ||
  CASE WHEN h % 12 = 5 THEN 'MUNICÍPIO DE ' || place || chr(10) || 'EDITAL Nº ' || CAST(k % 40 AS STRING) || '/' || CAST(year(d) AS STRING) || chr(10) || 'OBJETO: compra de merenda' || chr(10) ELSE '' END ||
  place || ', ' || coalesce(doc_date, 'sem data') AS text
FROM {titles} t
"""

EDITIONS = """
SELECT CAST(year(d) AS BIGINT) * 10000 + month(d) * 100 + day(d) AS edition_id,
  'https://gazette.example/ed/' || CAST(d AS STRING) || CASE WHEN day(d) % 5 = 0 THEN '/view' ELSE '.pdf' END AS url,
  CASE day(d) % 4 WHEN 0 THEN 'Edição ' || CAST(d AS STRING) WHEN 1 THEN 'Diário NATION_5 decreto ' || CAST(month(d) AS STRING)
    WHEN 2 THEN 'Caderno de esporte NATION_10' ELSE 'Prefeitura Municipal de NATION_5 - edital R$ 10,00' END AS title,
  CASE WHEN day(d) = 31 THEN NULL ELSE CAST(d AS STRING) END AS pub_date,
  CASE WHEN day(d) % 6 = 0 THEN NULL ELSE 'edicoes/' || CAST(d AS STRING) || '.pdf' END AS file_path,
  CASE WHEN day(d) % 4 = 0 THEN NULL ELSE 'edicoes/' || CAST(d AS STRING) || '.txt' END AS text_path,
  CAST(CASE WHEN (day(d) + month(d)) % 3 = 0 THEN 0 ELSE 1 END AS INT) AS processed,
  CAST(CASE WHEN (day(d) + year(d)) % 2 = 0 THEN 1 ELSE 0 END AS INT) AS has_target,
  CAST((day(d) * month(d)) % 5 AS INT) AS failures,
  CASE WHEN (day(d) * month(d)) % 5 > 0 THEN 'timeout na pagina ' || CAST(day(d) AS STRING) END AS failure_msg,
  CAST(CASE WHEN day(d) % 7 = 0 THEN NULL ELSE (day(d) * 13 + month(d) * 7) % 101 END AS INT) AS candidacy,
  CAST(CASE WHEN day(d) % 9 = 0 THEN NULL ELSE day(d) % 3 END AS INT) AS priority,
  CASE day(d) % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'pendente' WHEN 3 THEN 'revisada' WHEN 4 THEN 'ignorada' ELSE 'pendente' END AS review,
  CASE day(d) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{{"classificacao": "pendente"}}' ELSE '{{"classificacao": "materia"}}' END AS audit,
  CASE day(d) % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'reprocessar' END AS miss_hint,
  CASE day(d) % 5 WHEN 0 THEN 'pendente' WHEN 1 THEN 'ok' ELSE NULL END AS gap_status,
  CASE day(d) % 5 WHEN 0 THEN CASE month(d) % 3 WHEN 0 THEN 'under' WHEN 1 THEN 'critical' ELSE 'low' END ELSE 'none' END AS gap_severity,
  CAST(CASE WHEN day(d) % 5 = 0 THEN (day(d) * month(d)) % 101 END AS INT) AS gap_score
FROM (SELECT DISTINCT d FROM (
  SELECT CAST(o_orderdate AS DATE) AS d FROM {orders} UNION ALL SELECT CAST(l_shipdate AS DATE) AS d FROM {lineitem}) u) days
"""

MENTIONS = """
SELECT l_orderkey * 1000000 + l_partkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 AS mention_id,
  CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) * 10000 + month(CAST(l_shipdate AS DATE)) * 100 + day(CAST(l_shipdate AS DATE)) AS edition_id,
  CAST(1 + l_partkey % 12 AS INT) AS page,
  '...a ' || CASE l_returnflag WHEN 'A' THEN 'Prefeitura Municipal de NATION_5' WHEN 'N' THEN 'cidade de NATION_5' ELSE 'Câmara de NATION_5' END ||
    '  publicou o item ' || CAST(l_suppkey % 10 AS STRING) || ' da lista ' || CAST(l_linenumber AS STRING) || '...' AS excerpt,
  CASE l_linestatus WHEN 'F' THEN CASE l_returnflag WHEN 'A' THEN 'Prefeitura Municipal de NATION_5' WHEN 'N' THEN '11.222.333/0001-81' ELSE 'Câmara de NATION_5' END ELSE 'NATION_5' END AS term,
  CAST(l_suppkey % 2 AS INT) AS notified
FROM {lineitem}
"""

JOBS = """
SELECT event_id + 1 AS job_id,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(year(d) AS BIGINT) * 10000 + month(d) * 100 + day(d) END AS edition_id,
  'Edição ' || CAST(user_id AS STRING) AS title,
  CASE event_id % 4 WHEN 0 THEN 'baixando PDF' WHEN 1 THEN 'ocr' WHEN 2 THEN 'detectando edições' ELSE 'ia' END AS stage,
  CASE event_type WHEN 'error' THEN 'erro' WHEN 'signup' THEN 'rodando' WHEN 'purchase' THEN 'aviso' ELSE 'concluido' END AS status,
  CASE event_type WHEN 'error' THEN 'Traceback: falha ' || props WHEN 'view' THEN 'ok' ELSE props END AS message,
  CAST(ts AS TIMESTAMP) AS updated_at, user_id, value, event_type
FROM (SELECT e.*, DATE '1995-01-01' + CAST(user_id AS INT) AS d FROM {events} e) x
"""

RESPONSES = """
SELECT k AS act_id,
  '{{"acao": "' || CASE h % 6 WHEN 0 THEN 'descartar' WHEN 1 THEN 'so-mencao' WHEN 2 THEN 'Discard ' ELSE 'manter' END || '"' ||
  CASE WHEN h % 19 = 0 THEN ', "pertence_a_alvo": false' ELSE ', "pertence_a_alvo": true' END ||
  CASE WHEN h % 23 = 0 THEN ', "tem_mencao_alvo": false' ELSE '' END ||
  CASE WHEN h % 4 = 0 THEN ', "orgao": "Prefeitura Municipal de ' || place || '"' ELSE '' END ||
  CASE WHEN h % 5 < 2 THEN ', "tipo": "' || coalesce(act_type, 'Decreto') || '"' ELSE '' END ||
  CASE WHEN h % 5 > 2 THEN ', "numero": "' || coalesce(number, '77/2000') || '"' ELSE '' END ||
  CASE WHEN h % 7 = 3 THEN ', "valor": "R$ 999.999,00"' WHEN h % 7 = 4 THEN ', "valor": "valor de R$ ' || money || '"' ELSE '' END ||
  CASE WHEN h % 3 = 0 THEN ', "data_documento": "' || coalesce(doc_date, '1 de maio de 1999') || '"' ELSE '' END ||
  CASE WHEN h % 8 = 0 THEN ', "assunto": "Assunto de ' || lower(seg) || '"' ELSE '' END ||
  CASE WHEN h % 2 = 0 THEN ', "resumo": "Resumo novo por R$ ' || money || '"' ELSE '' END ||
  CASE WHEN h % 6 = 5 THEN ', "importancia": ' || CAST(h % 8 AS STRING) ELSE '' END ||
  CASE WHEN h % 10 = 3 THEN ', "notificar": false' ELSE '' END ||
  CASE WHEN h % 4 = 1 THEN ', "temas": ["Obras", "Saúde"]' ELSE ', "tags": ["licita", "x y"]' END ||
  ', "partes": {{"contratante": "' || place || '", "contratada": "Lourdes Emas Fernande"}}' ||
  ', "i": ' || CAST(1 + h % 9 AS STRING) || ', "classificacao": "' || CASE h % 3 WHEN 0 THEN 'Ato' WHEN 1 THEN 'materia' ELSE '' END || '"' ||
  CASE WHEN h % 29 = 0 THEN '' ELSE '}}' END AS response
FROM {titles} t
"""

METRICS = """
SELECT CAST(year(d) AS BIGINT) * 10000 + month(d) * 100 + day(d) AS edition_id,
  CAST(n AS BIGINT) AS raw_acts, CAST(n - n % 3 AS BIGINT) AS final_acts, CAST(n % 3 AS BIGINT) AS model_drops, CAST(n % 2 AS BIGINT) AS neighbour_drops,
  CAST(2 + n % 9 AS BIGINT) AS pages, CAST(n % 3 AS BIGINT) AS weak_pages, CAST(n * 2 AS BIGINT) AS mentions
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM {orders} GROUP BY CAST(o_orderdate AS DATE)) g
"""

WORDS = """
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page, CAST(l_linenumber % 2 AS INT) AS col, CAST((l_linenumber % 2) * 500 AS INT) AS x_offset,
  l_orderkey * 1000000 + l_partkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 AS pos,
  CASE WHEN l_quantity < 3 THEN '  ' WHEN l_partkey % 9 = 0 THEN 'DECRETO' ELSE 'w' || CAST(l_partkey AS STRING) END AS text,
  CASE WHEN l_discount > 0.085 THEN '-1' WHEN l_discount > 0.075 THEN 'x' ELSE CAST(CAST(round(l_discount * 1000) AS INT) AS STRING) END AS conf,
  CAST(l_suppkey % 3 AS INT) AS block_num, CAST(1 + l_suppkey % 2 AS INT) AS par_num, CAST(l_linenumber AS INT) AS line_num,
  CAST(l_quantity * 7 AS INT) AS lft, CAST(l_linenumber * 40 + l_suppkey % 13 AS INT) AS top, CAST(10 + l_partkey % 50 AS INT) AS width, CAST(12 + l_suppkey % 5 AS INT) AS height
FROM {lineitem}
"""

BLOCKS = """
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page,
  CAST((1 + l_linenumber % 2) * 1000 + l_partkey % 400 AS INT) AS block, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 AS seq,
  CASE l_partkey % 6 WHEN 0 THEN 'DECRETO Nº ' || CAST(l_suppkey AS STRING) || '/2000' WHEN 1 THEN 'PREFEITURA MUNICIPAL DE NATION_5' || chr(10) || 'EDITAL Nº 3/1999'
    WHEN 2 THEN 'Art. 3 esta lei federal' WHEN 3 THEN '' ELSE 'texto corrido do item ' || CAST(l_linenumber AS STRING) END AS text,
  CAST(l_quantity AS INT) AS l, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4000 AS INT) AS t, CAST(l_quantity AS INT) + 200 AS r,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4000 AS INT) + 20 + CAST(l_suppkey % 30 AS INT) AS b
FROM {lineitem}
"""

FILES = """
SELECT 'edicoes/' || CAST(d AS STRING) || CASE l_linestatus WHEN 'F' THEN '.pdf' ELSE '.ocr.json' END AS path,
  CAST(sum(l_quantity) * 100 AS BIGINT) AS bytes, CAST(max(l_shipdate) AS TIMESTAMP) AS modified
FROM (SELECT CAST(l_shipdate AS DATE) AS d, l_linestatus, l_quantity, l_shipdate FROM {lineitem}) s
GROUP BY d, l_linestatus
"""

# intermediate steps of the order-based tables, in order of use
STEPS: dict[str, str] = {"base": _BASE, "fields": _FIELDS, "titles": _TITLES}

PROJECTIONS: dict[str, str] = {
    "gz_acts": ACTS, "gz_pages": PAGES, "gz_editions": EDITIONS, "gz_mentions": MENTIONS, "gz_jobs": JOBS,
    "gz_responses": RESPONSES, "gz_metrics": METRICS, "gz_words": WORDS, "gz_blocks": BLOCKS, "gz_files": FILES,
}
