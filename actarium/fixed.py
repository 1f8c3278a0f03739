"""Fixed values.

Everything in this module is a constant that decides results (word lists, tables, patterns, formats).
They are stated here as plain text so that the operators themselves hold only logic.
Patterns marked "folded" are meant for accent-stripped lower-case text.
"""

# --- accent folding -------------------------------------------------------------------------
FOLD_FROM = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿºª"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuucnyyoa"

# --- act titles (folded) --------------------------------------------------------------------
SIMPLE_TYPES = (
    "decreto", "portaria", "lei", "edital", "aviso", "extrato", "dispensa", "inexigibilidade",
    "homologacao", "adjudicacao", "termo", "resolucao", "errata", "notificacao", "demonstrativo",
    "relatorio", "balanco", "rgf", "rreo",
)
COMPOUND_TYPES = (
    r"extrato\s+(?:do\s+|de\s+|re\s+)?(?:termo\s+(?:de\s+)?)?contrato",
    r"extrato\s+de\s+contrato",
    r"contrato\s+administrativo",
    r"termo\s+(?:de\s+)?aditivo(?:\s+de\s+contrato)?",
    r"termo\s+aditivo",
    r"termo\s+de\s+homologacao(?:\s+e\s+adjudicacao)?",
    r"homologacao\s+e\s+adjudicacao",
    r"dispensa\s+(?:de\s+)?licitacao",
    r"pregao\s+eletronico",
)
ORDINALS = (
    "primeiro", "segundo", "terceiro", "quarto", "quinto", "sexto", "setimo", "oitavo", "nono", "decimo",
    "1[o.]", "2[o.]", "3[o.]", "4[o.]", "5[o.]", "6[o.]", "7[o.]", "8[o.]", "9[o.]", "10[o.]",
)
# a "number sign": the ordinal signs fold to "o"
NUMBER_SIGN = r"n[o°.]"


def _by_first_letter(alternatives: tuple[str, ...]) -> str:
    """The alternatives as one group, joined under their first letter (order kept within a letter): a matcher then
    compares a dozen letters per word instead of fifty phrases."""
    groups: dict[str, list[str]] = {}
    for a in alternatives:
        groups.setdefault(a[0], []).append(a[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


ORDINAL_PREFIX = "(?:" + _by_first_letter(ORDINALS) + r"\s+)?"
ANY_TYPE = _by_first_letter(COMPOUND_TYPES + SIMPLE_TYPES)
TITLE_LINE = r"^\s*" + ORDINAL_PREFIX + ANY_TYPE + r"\b"
TITLE_TYPE = r"\b" + ORDINAL_PREFIX + "(" + ANY_TYPE + r")\b"
TITLE_TYPE_NUMBER = TITLE_TYPE + r"\s*(?:" + NUMBER_SIGN + r"?\s*)?(\d{1,6}(?:[./-]\d{1,4})?)?"
TITLE_MID_LINE = r".{0,20}" + ORDINAL_PREFIX + ANY_TYPE + r"\b.{0,40}" + NUMBER_SIGN + r"?\s*\d"
TYPE_WITH_MARK = ANY_TYPE + r"\b\s*" + NUMBER_SIGN + "?"
ACT_HINT = r"n[o°.]?|aditivo|contrato|dispensa|homolog|extrato|decreto|portaria"
SUBJECT_LABEL = r"\b(sumula|ementa|objeto|assunto)\b\s*[:\-]?\s*(.+)"
SUBJECT_LABEL_RAW = r"(?i)\b(S[ÚU]MULA|EMENTA|OBJETO|ASSUNTO)\b\s*[:\-]?\s*(.+)"
LEGAL_REFERENCE = r"\b(lei\s+(federal|estadual|organica)|art\.?\s*\d+|inciso|paragrafo|loa)\b"
LEGAL_REFERENCE_KEPT = r"\b(lei|decreto|portaria|edital|aviso|extrato|termo|resolucao)\b\s*n[o°.]?"
FOOTER_LINE = (
    r"^(cep|e-mail|email|fone|telefone|gabinete do prefeito|assinado|prefeito municipal)\b"
)
CONTINUATION = r"^(art\.?\s*\d+|paragrafo|inciso|gabinete do prefeito|assinado)"
ARTICLE_START = r"^\s*(art\.?\s*\d+|paragrafo|inciso)\b"
SUBJECT_KEYWORDS = ("abertura", "credito", "licitacao", "homologar", "adjudicar", "objeto", "contratacao")
SUBJECT_CUT = r"(?i)\b(A CÂMARA MUNICIPAL|A CAMARA MUNICIPAL|Art\.?\s*\d+|RESOLVE)\b"

OFFICIAL_SIGNALS = (
    "prefeitura municipal", "camara municipal", "municipio de", "estado do parana", "cnpj", "lei organica",
    "licitacao", "processo", "decreto", "portaria", "edital",
)
FISCAL_WORDS = ("relatorio", "demonstrativo", "balanco", "lrf", "rgf", "rreo")
IGNORED_CONTEXT = (
    "distribuição avulsa", "distribuicao avulsa", "auto posto", "panificadora", "farmácia", "farmacia",
    "loterias", "patrocinadores", "anunciante", "anunciantes",
)
SPONSOR_PHRASE = "distribuicao avulsa"
BRAND_OVERRIDE = ("prefeitura", "camara municipal", "cnpj")

# --- field patterns -------------------------------------------------------------------------
DATE_LONG = r"(?i)\b\d{1,2}\s+de\s+[A-Za-zçÇãÃéÉ]+\s+de\s+\d{4}\b"
DATE_NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
MONEY = r"(?i)R\s*[$S]\s*[\d.,]+"
MONEY_AFTER_LABEL = r"(?i)valor\s+de\s+(R\s*[$S]\s*[\d.,]+)"
PERSONAL_ID = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
PROCESS_NUMBER = r"(?i)processo\s*n[º°o.]?\s*(\d{1,6}(?:[./-]\d{1,6})?)"
SEQ_YEAR = r"(\d{1,6}\s*[/\-]\s*\d{2,4})"
# numbers introduced by a typed title (folded), in order of preference
TYPED_NUMBERS = (
    r"extrato\s+(?:do\s+|de\s+)?contrato\s+n[o°.]?\s*" + SEQ_YEAR,
    r"contrato\s+(?:administrativo\s+)?n[o°.]?\s*" + SEQ_YEAR,
    r"termo\s+aditivo[^\n]{0,40}n[o°.]?\s*" + SEQ_YEAR,
    r"decreto\s+(?:municipal\s+)?n[o°.]?\s*" + SEQ_YEAR,
    r"portaria\s+n?[o°.]?\s*" + SEQ_YEAR,
    r"dispensa[^\n]{0,30}n[o°.]?\s*" + SEQ_YEAR,
    r"pregao\s+eletronico\s+n[o°.]?\s*" + SEQ_YEAR,
    r"termo\s+de\s+homologacao[^\n]{0,40}n?[o°.]?\s*" + SEQ_YEAR,
    r"homologacao(?:\s+e\s+adjudicacao)?[^\n]{0,40}n?[o°.]?\s*" + SEQ_YEAR,
    r"adjudicacao[^\n]{0,30}n?[o°.]?\s*" + SEQ_YEAR,
)
# a piece that any text matched by the pattern of the same place holds
TYPED_TRIGGERS = ("extrato", "contrato", "aditivo", "decreto", "portaria", "dispensa", "pregao", "homologacao", "homologacao", "adjudicacao")
GENERIC_NUMBER = r"n[o°.]?\s*(\d{1,6}\s*[/\-]\s*20\d{2})\b"
MARKED_NUMBER = r"(?:n[o°.]?|numero\s*:?)\s*(\d{1,6}(?:\s*[/\-.]\s*\d{2,4})?)\b"

# --- scan repairs ---------------------------------------------------------------------------
# (pattern, replacement); SCAN_TRIGGERS gives a lower-case piece that any text matched by the rule holds
GLUED_TITLES = (
    (r"(?i)\bLEI\s*N[º°O.]", "LEI Nº"),
    (r"(?i)\bLEIN[º°O.]", "LEI Nº"),
    (r"(?i)\bPORTARIAN[º°O.]", "PORTARIA Nº"),
    (r"(?i)\bDECRETON[º°O.]", "DECRETO Nº"),
)
CUT_TITLES = (
    (r"(?i)\bE?X?TRATO\s+DO\s+CONTRATO\b", "EXTRATO DO CONTRATO"),
    (r"(?i)\bRATO\s+DO\s+CONTRATO\b", "EXTRATO DO CONTRATO"),
    (r"(?i)\bEXTRATO\s+RE\s+CONTRATO\b", "EXTRATO DE CONTRATO"),
    (r"(?i)\bCONTRATO\s+ADMINISTRATIVO\b", "CONTRATO ADMINISTRATIVO"),
)
GLUED_TRIGGERS = ("lei", "lein", "portarian", "decreton")
CUT_TRIGGERS = ("trato", "rato", "extrato", "administrativo")

LITERAL_REPAIRS = (
    ("TPCA/IBGE", "IPCA/IBGE"), ("Art,", "Art."), ("virgnta", "vírgula"),
    ("deforma ligital", "de forma digital"), ("Agsirado", "Assinado"),
    ("Prefeito Mui ral", "Prefeito Municipal"), ("servidores públicas", "servidores públicos"),
    ("LEINº", "LEI Nº"),
)
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\u200b-\u200f\ufeff]"

# --- canonical labels -----------------------------------------------------------------------
TYPE_LABELS = (
    ("termo de homologacao e adjudicacao", "Homologação/Adjudicação"),
    ("homologacao e adjudicacao", "Homologação/Adjudicação"),
    ("termo de homologacao", "Homologação/Adjudicação"),
    ("homologacao", "Homologação/Adjudicação"),
    ("adjudicacao", "Homologação/Adjudicação"),
    ("extrato de termo de aditivo", "Termo Aditivo"),
    ("extrato de termo aditivo", "Termo Aditivo"),
    ("termo de aditivo", "Termo Aditivo"),
    ("termo aditivo", "Termo Aditivo"),
    ("extrato de termo de rescisao", "Extrato de Rescisão"),
    ("extrato de contrato", "Extrato de Contrato"),
    ("aviso de licitacao", "Aviso de Licitação"),
    ("chamamento publico", "Chamamento Público"),
    ("concorrencia eletronica", "Concorrência"),
    ("concorrencia", "Concorrência"),
    ("dispensa de licitacao", "Dispensa"),
    ("dispensa eletronica", "Dispensa"),
    ("dispensa", "Dispensa"),
    ("inexigibilidade", "Inexigibilidade"),
    ("relatorio de gestao fiscal", "RGF"),
    ("demonstrativo", "Demonstrativo"),
    ("rreo", "RREO"),
    ("rgf", "RGF"),
    ("portaria", "Portaria"),
    ("decreto", "Decreto"),
    ("edital", "Edital"),
    ("resolucao", "Resolução"),
    ("notificacao", "Notificação"),
    ("errata", "Errata"),
    ("contrato", "Contrato"),
    ("lei", "Lei"),
    ("ato administrativo", "Ato"),
)
GENERIC_TYPES = ("", "ato", "atos", "outros", "outro", "termo", "publicacao", "n/a", "na", "nao identificado")
THEMES = (
    "licitacao", "contrato", "obra", "saude", "educacao", "rh", "fiscal", "assistencia", "infraestrutura",
    "meio_ambiente", "cultura", "transporte", "outros",
)
THEME_ALIASES = (
    ("licitação", "licitacao"), ("licitacoes", "licitacao"), ("pregão", "licitacao"), ("pregao", "licitacao"),
    ("dispensa", "licitacao"), ("contratos", "contrato"), ("aditivo", "contrato"), ("obras", "obra"),
    ("asfalto", "obra"), ("paviment", "obra"), ("saúde", "saude"), ("saude", "saude"),
    ("educação", "educacao"), ("escola", "educacao"), ("pessoal", "rh"), ("nomeacao", "rh"),
    ("nomeação", "rh"), ("exoneracao", "rh"), ("portaria", "rh"), ("rgf", "fiscal"), ("rreo", "fiscal"),
    ("lrf", "fiscal"), ("balanco", "fiscal"), ("balanço", "fiscal"), ("assistência", "assistencia"),
    ("social", "assistencia"),
)
STOP_TOKENS = (
    "para", "com", "por", "dos", "das", "uma", "que", "nao", "mais", "como", "este", "esta", "pelo", "pela",
    "seu", "sua",
)
MONTHS = (
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro",
    "novembro", "dezembro",
)
MONTH_LABELS = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro",
    "Novembro", "Dezembro",
)

# --- linkage --------------------------------------------------------------------------------
SIGNATURE_KEYWORDS = (
    "lourdes", "elias", "fernandes", "combust", "litro", "aditivo", "quinto", "elite", "veiculo", "picape",
    "pickup", "pregao", "homolog",
)
SIGNATURE_AMOUNTS = r"\b(25\.?000|104\.?000|255\.?800)\b"
STRONG_KEYWORDS = ("aditivo", "lourdes", "elias", "combust", "litro")
SIGNED_FAMILIES = ("termo_aditivo", "contrato", "extrato_contrato", "dispensa")
FUSED_GROUPS = ("contrato_aditivo", "extrato_contrato", "dispensa", "homologacao")

# --- enrichment -----------------------------------------------------------------------------
TRIAGE_DISCARD = ("descartar", "discard", "rejeitar")
TRIAGE_MENTION = ("so_mencao", "so-mencao", "mencao")
FOREIGN_ORGAN_PHRASES = (
    "municipio de", "prefeitura de", "prefeitura municipal de", "camara de", "camara municipal de",
)
PARTY_REPAIRS = (("emas", "elias", r"(?i)\bEmas\b", "Elias"), ("fernande", "fernandes", r"(?i)\bFernande\b", "Fernandes"))
VALUE_REQUIRED = ("contrato", "dispensa", "homolog", "extrato", "aditivo", "pregao")
LEGAL_BASIS = r"fundament|base\s+legal|nos termos|lei\s+n"
CHECK_ITEMS = ("numero", "data", "valor", "orgao", "objeto", "fundamentacao")
ANOMALY_TYPES = ("dispensa", "contrato", "homolog", "aditivo")
FISCAL_KEYS = (
    "rgf", "rreo", "lrf", "balanco", "gestao fiscal", "relatorio de gestao", "demonstrativo",
    "responsabilidade fiscal",
)
IMPORTANCE_CONTRACT = ("contrato", "dispensa", "homolog", "licitacao", "pregao")
IMPORTANCE_FISCAL = ("rgf", "rreo", "lrf", "balanco", "fiscal")
IMPORTANCE_STAFF = ("nomeacao", "exoneracao", "portaria", "decreto")

# --- quality --------------------------------------------------------------------------------
DIGIT_CONFUSIONS = {
    "0": "689", "1": "7", "2": "783", "3": "892", "5": "68", "6": "05", "7": "12", "8": "02359", "9": "038",
}
REQUEUE_VALUE_TYPES = ("contrato", "extrato", "dispensa", "homolog", "aditiv", "pregao", "inexigib")
WEAK_BONUS_TYPES = ("contrato", "aditivo", "extrato", "pregao", "licita")

# --- queue scoring --------------------------------------------------------------------------
CANDIDACY_ORGANS = (
    "prefeitura municipal", "camara municipal", "municipio de", "conselho municipal", "fundo municipal",
)
CANDIDACY_TYPES = (
    "decreto", "portaria", "lei municipal", "edital", "dispensa", "homolog", "extrato de contrato", "termo de",
    "rgf", "rreo", "licitacao", "pregao",
)
CANDIDACY_NEWS = ("colunista", "esporte", "futebol", "obituario", "classificados", "publicidade")
CHAIN_TYPES = ("contrato", "aditivo", "dispensa", "homolog", "rescis")

# --- export ---------------------------------------------------------------------------------
EXPORT_FIELDS = (
    "act_id", "edition_id", "edition_title", "pub_date", "page", "category", "organ", "act_type", "number",
    "doc_date", "subject", "value", "summary", "importance", "confidence", "confidence_level", "flags",
    "created_day",
)
