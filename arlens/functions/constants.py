"""Fixed values that must equal the source system's for identical results.

These are business vocabulary of the billing/ledger exports (document types,
currency and company labels, collection prefixes, aging buckets, header
candidates). They are stated once here, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
# Credit-note document types (invoice export, column "Documento").
CREDIT_NOTE_TYPES = [
    "Nota de Crédito de Ventas Electrónica",
    "FCE Nota de Crédito de Ventas Electrónica MIPymes",
]

# Currency label -> ISO code; unmapped labels pass through unchanged.
CURRENCY_MAP = {
    "Pesos": "ARS",
    "Dólares": "USD",
    "Dollars": "USD",
}

# Ledger document prefixes (text before " - ", upper-cased) that mark a
# collection or credit note.
COLLECTION_PREFIXES = ["COBRANZA", "COBRANZA_FCE", "NCVEE", "FCEVCTA", "FCEINCVTAELEC", "FCENCVTAELEC"]

# Movement types.
MOV_OPENING = "Saldo Inicial"
MOV_COLLECTION = "Cobro/NC"
MOV_CHARGE = "Factura/Cargo"

# Aging buckets in display order (upper bound of days overdue, label).
AGING_BUCKETS = [
    (0, "Al día"),
    (30, "1–30 días"),
    (60, "31–60 días"),
    (90, "61–90 días"),
    (None, "+90 días"),
]
AGING_CRITICAL = "+90 días"
AGING_CURRENT = "Al día"
NO_DEBT = "Sin deuda"

# Aging source labels.
SOURCE_COMPOSITION = "composicion"
SOURCE_LEDGER = "cc_movimientos"

# Default labels.
NO_CENTER = "Sin centro"
NO_LINE = "SIN LINEA"

# Composition sheet: candidate header names per role (normalised form), tried
# in this order for an exact match, then as substrings in column order.
COMPOSITION_ROLES = {
    "cliente": ["cliente", "razon_social", "razonsocial"],
    "centro": ["centro_de_costo", "centro_costo", "centro", "linea_negocio", "nivel_1_dimension", "dim_valor"],
    "saldo": ["saldo_abierto", "saldo", "importe_pendiente", "pendiente", "deuda", "importe"],
    "venc": ["fecha_vencimiento", "vencimiento", "fecha_vto", "fecha_de_vencimiento"],
    "doc": ["documento", "comprobante", "factura", "numero_comprobante", "numero_factura"],
}
# Header rows scanned for the composition header.
COMPOSITION_HEADER_ROWS = 8

# Upload check of a composition workbook: header rows 0..5, tokens matched as
# substrings of the alphanumeric-only lower-case header.
FLEX_CLIENT_TOKENS = ["cliente", "razonsocial", "razon", "social"]
FLEX_BALANCE_TOKENS = ["saldoabierto", "saldo", "importependiente", "pendiente", "deuda", "importe"]
FLEX_HEADER_ROWS = 6

# Composition workbook discovery: exact names first, then glob patterns
# (lexicographic inside each), never the ledger workbook.
COMPOSITION_FILE_NAMES = ["composicion_saldos.xlsx", "composicion_de_saldos.xlsx", "cc_composicion.xlsx"]
COMPOSITION_FILE_PATTERNS = ["*composicion*.xlsx", "*composición*.xlsx", "Reporte*.xlsx", "*saldos*.xlsx"]
LEDGER_FILE_NAME = "cc_clientes.xlsx"

# Required upload columns.
REQUIRED_INVOICE_COLUMNS = ["Fecha", "Cliente", "Empresa", "Moneda", "Documento",
                            "Importe mon. principal", "Imp. usd", "Nivel 1 dimensión"]

# Post-run quality checks: required product columns.
QUALITY_INVOICE_COLUMNS = ["fecha", "monto_total_ars"]
QUALITY_BALANCE_COLUMNS = ["cliente", "saldo_actual", "saldo_vencido", "dias_vencido", "aging"]
QUALITY_ITEM_COLUMNS = ["centro_costo", "saldo_abierto"]

# Reconciliation tolerance (currency units) and KPI windows.
RECONCILE_TOLERANCE = 1.0
KPI_BILLING_DAYS = 90
KPI_COVERAGE_DAYS = 30
BRIEFING_CRITICAL_DAYS = 60
# --- end of fixed values ----------------------------------------------------
