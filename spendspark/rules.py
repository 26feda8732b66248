"""Code lists, word lists, patterns and limits that results depend on. Plain text, in natural order.

``Rules`` holds those of the parser that a deployment may replace; ``sources/rule_tables`` reads and writes them as a table.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: enumerations and labels (order is the label encoding) ---
CATEGORIES = ["Food & Dining", "Groceries", "Transport", "Shopping", "Bills & Utilities", "Entertainment", "Health", "Education", "Rent & Housing", "Investments", "Transfers", "Cash", "Travel", "Income", "Other"]
CHANNELS = ["UPI", "CARD", "ATM", "IMPS", "NEFT", "RTGS", "NETBANKING", "AUTOPAY", "WALLET", "UNKNOWN"]
CATEGORY_SOURCES = ["USER", "MEMORY", "MODEL", "SEED", "NONE"]
ENUM_DEFAULTS = {
    "source": (["SMS", "NOTIFICATION", "STATEMENT", "LEDGER_CSV", "MANUAL"], "SMS"),
    "direction": (["DEBIT", "CREDIT"], "DEBIT"),
    "channel": (CHANNELS, "UNKNOWN"),
    "category_source": (CATEGORY_SOURCES, "NONE"),
    "loc_confidence": (["HIGH", "MEDIUM", "LOW", "NONE"], "NONE"),
}

# --- Fixed values: sender codes ---
BANK_CODES = [
    "hdfcbk", "hdfcbn", "sbiinb", "sbiupi", "sbibnk", "sbicrd", "atmsbi", "icicib", "icicit", "axisbk", "axisbn", "kotakb", "kotak", "pnbsms",
    "pnbbnk", "bobtxn", "bobibn", "canbnk", "cbssbi", "unionb", "ubinet", "idfcfb", "yesbnk", "indusb", "aubank", "rblbnk", "fedbnk", "citibk",
    "hsbcin", "scbank", "idbibk", "bankin", "cbinbk", "iobchn", "ucobnk", "psbbnk", "dcbbnk", "equtas", "esafbk", "jkbank", "karbnk", "kvbank",
    "tmbank", "amexin", "onecrd", "slcebk",
]
PSP_CODES = [
    "paytmb", "paytm", "phonpe", "phnpay", "gpayin", "bhimup", "npcibh", "amzonp", "amazon", "mobikw", "freechg", "cred", "slice", "jupitr", "fisdom",
    "razrpy", "cashfr",
]

# --- Fixed values: patterns of the message parser ---
REJECT_OTP = r"(?iu)\botp\b|one[\s-]?time[\s-]?password|verification code|\bcvv\b"
REJECT_PROMO = r"(?iu)pre[\s-]?approved|apply now|click here|hurry|limited period|offer ends|t&c apply|download the app|you have won|congratulations|lowest interest|upgrade your|activate now|refer and earn"
REJECT_NOT_YET = r"(?iu)will be (?:debited|deducted|credited|charged|transferred|reversed|refunded|blocked|processed)|is due|due on|due date|(?:collect|payment|money) request|has requested|requesting|(?:failed|declined|unsuccessful|not processed|could not be processed)|\bnot (?:debited|credited|deducted|charged)\b|\brejection\b|to (?:authorise|authorize|approve)|scheduled"
REJECT_INFO_ONLY = r"(?iu)mini statement|statement is ready|statement has been generated|e-statement"
AMOUNT_PREFIXED = r"(?iu)(?:rs\.?|inr|₹)\s*\.?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
AMOUNT_SUFFIXED = r"(?iu)(?<![xX*\d])([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*(?:rs\.?|inr|rupees)\b"
AMOUNT_BARE = r"(?iu)(?:debited|credited|debit|credit|spent|paid|withdrawn|sent)\s*(?:by|for|with|of|:)?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)(?!\d)"
BALANCE_CONTEXT = r"(?iu)(?:avl|avail(?:able)?|closing|current|a\/c|total)?\s*(?:bal|balance|limit)\s*(?:is|of|:)?\s*(?:rs\.?|inr|₹)?\s*$"
DEBIT_WORDS = [
    "debited", "debit", "spent", "paid", "withdrawn", "withdrawal", "purchased", "purchase", "deducted", "charged", "sent", "transferred", "trf to", "used for", "used at",
    "was used", "using your", "payment of", "txn of", "recharge of", "top-up of", "topup of", "top-up amounting", "topup amounting",
]
CREDIT_WORDS = ["credited", "credit", "received", "deposited", "refund", "reversed", "cashback", "added to", "has been credited"]
CARD_PHRASE, CREDIT_LIMIT = r"(?iu)(credit|debit)\s*card", r"(?iu)credit\s*limit"
ACCOUNT_LABELLED = r"(?iu)(?:a\/c|a\.c|ac|acct|account|card)\s*(?:no\.?|number|ending(?:\s*with)?)?\s*[:#\-]?\s*[xX*]{0,8}\s*(\d{3,6})"
ACCOUNT_MASKED = r"[xX*]{2,}\s?(\d{3,6})\b"
REF = r"(?iu)(?:(?:retrieval\s+)?ref(?:erence)?|rrn|utr|txn(?:\s*id)?|upi(?:\s*ref(?:\s*no)?)?|transaction\s*id)\s*(?:no\.?|id|#)?\s*[:.\-]?\s*([A-Za-z0-9]{6,25})"
VPA_ANY = r"(?iu)\b([a-z0-9][a-z0-9._\-]{1,}@[a-z]{2,})\b"
_NAME_END = r"(?=\s+(?:on|ref|refno|retrieval|upi|rs|inr|txn|avl|avail|bal|dt|date|not|via|thru|for|from|as|per|standing|credited|debited|is|has|call|sms)\b|[.,;:\n]|$)"
_NAME_BODY = r"[A-Za-z][A-Za-z0-9 &.'\-]{2,40}?"
MERCHANT_PATTERNS = [
    r"(?iu)\b(?:to|towards)\s+vpa\s+([a-z0-9._\-]{2,}@[a-z]{2,})",
    VPA_ANY,
    r"\b[A-Z]{2,6}\*([A-Za-z][A-Za-z0-9 &.'\-]{1,40}?)(?=[.,;:\n]|$)",
    rf"(?iu);\s*({_NAME_BODY})\s+credited\b",
    rf"(?iu)\b(?:trf to|transferred to|transfer to|paid to|sent to|payment to|to)\s+({_NAME_BODY}){_NAME_END}",
    rf"(?iu)\bat\s+({_NAME_BODY}){_NAME_END}",
    r"(?iu)\binfo\s*[:\-]\s*([A-Za-z0-9][A-Za-z0-9 &.'\-/]{2,40}?)(?=[.,;\n]|$)",
    rf"(?iu)\b(?:towards|for)\s+({_NAME_BODY}){_NAME_END}",
    r"(?iu)\bfor your\s+((?:[A-Za-z]+\s+){0,3}credit card)\b",
]
MERCHANT_FROM = rf"(?iu)\bfrom\s+({_NAME_BODY}){_NAME_END}"
MERCHANT_LABEL = r"(?iu)^(?:merchant|payee|vpa|beneficiary|your)\s*:?\s+"
CURRENCY_ONLY = r"(?iu)^(?:rs|inr|₹)\b"
OWN_ACCOUNT = r"(?iu)^(?:savings|current|salary|joint|nre|nro)?\s*(?:a/?c|account|acct)\b"
TRAILER = r"(?iu)\b(?:not you\?|if not you|if this was not|to block|to report|to dispute|call \d|sms block|helpline|customer care|do not share)"
DATE_TOKEN = r"(?iu)\b(?:on|dt|date)\s*[:\-]?\s*(\d{1,2}[-/ ][A-Za-z]{3}[-/ ]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{2}[A-Za-z]{3}\d{2,4})"
BODY_DATES = ["d-M-yy", "d-M-yyyy", "d/M/yy", "d/M/yyyy", "d-MMM-yy", "d-MMM-yyyy", "d MMM yy", "d MMM yyyy", "d/MMM/yy", "d/MMM/yyyy", "ddMMMyy", "ddMMMyyyy"]
FILE_DATES = [*BODY_DATES, "yyyy-M-d", "yyyy/M/d", "d.M.yy", "d.M.yyyy"]

# --- Fixed values: merchant keys ---
MERCHANT_SUFFIXES = [
    "private limited", "pvt limited", "pvt ltd", "pvt. ltd", "private ltd", "limited", "ltd", "pvt", "private", "llp", "inc", "corp", "co", "india", "in",
    "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "pune", "chennai",
]
MERCHANT_PREFIXES = ["mr", "mrs", "ms", "dr", "shri", "smt", "kum", "sri"]

# --- Fixed values: statement files ---
DATE_KEYS = ["value date", "txn date", "transaction date", "tran date", "posting date", "date"]
NARRATION_KEYS = ["narration", "description", "particulars", "transaction remarks", "transaction details", "remarks", "details"]
DEBIT_KEYS = ["withdrawal amt", "withdrawal amount", "debit amount", "withdrawal", "debit", "paid out", "dr"]
CREDIT_KEYS = ["deposit amt", "deposit amount", "credit amount", "deposit", "credit", "paid in", "cr"]
AMOUNT_KEYS = ["transaction amount", "txn amount", "amount"]
BALANCE_KEYS = ["closing balance", "available balance", "running balance", "balance"]
REF_KEYS = ["chq/ref no", "ref no./cheque no", "reference no", "transaction id", "txn id", "utr no", "reference", "ref no", "cheque no", "utr"]
NARRATION_REF = r"(?i)\b(?:UPI|IMPS|NEFT|RTGS|UTR|RRN|MMT|ACH)[\s/:\-]{1,3}([A-Z0-9]{8,22})"
SCHEME_WORDS = [
    "upi", "imps", "neft", "rtgs", "ach", "pos", "atm", "mmt", "inb", "nwd", "dr", "cr", "p2a", "p2m", "payment", "transfer", "txn",
]
LEDGER_COLUMNS = ["occurred_at", "direction", "amount_inr", "merchant", "category", "category_source", "channel", "account_tail", "reference", "balance_inr", "latitude", "longitude"]

# --- Fixed values: limits ---
NEAR_MS, DAY_MS = 180_000, 86_400_000
AMOUNT_BANDS = [50, 150, 400, 1_000, 3_000, 10_000, 30_000]
BUCKETS, FNV_OFFSET, FNV_PRIME = 1 << 14, 2_166_136_261, 16_777_619
TRUST_STEPS, ACCEPT, SEED_CONFIDENCE = 25, 0.62, 0.45
FRESH_STEPS, FRESH_RATE, REPLAY_ROWS, REPLAY_RATE, EPOCHS, EPOCH_RATE, DECAY = 5, 0.15, 48, 0.05, 12, 0.08, 1e-6

#: Default lexicon of general words; a deployment passes its own table of brands (pattern, category).
LEXICON = {
    "Food & Dining": "restaurant bakery cafe canteen sweets dhaba biryani pizza foods",
    "Groceries": "supermarket kirana vegetable dairy provision grocery",
    "Transport": "petrol fuel parking toll metro taxi cab",
    "Shopping": "fashion electronics lifestyle mart store",
    "Bills & Utilities": "electricity broadband recharge postpaid municipal water",
    "Entertainment": "cinema movies games music",
    "Health": "hospital clinic pharmacy medical dental fitness diagnostic",
    "Education": "university college institute coaching tuition academy school",
    "Rent & Housing": "rent landlord apartment society",
    "Investments": "securities insurance mutual broker",
    "Transfers": "transfer",
    "Cash": "withdrawal",
    "Travel": "airlines hotel resort railway travels",
    "Income": "salary interest dividend",
}


@dataclass(frozen=True)
class Rules:
    """What the parser goes by. gates: reason and pattern, in order; a message that one matches is rejected for its reason."""

    bank_codes: tuple[str, ...] = tuple(BANK_CODES)
    psp_codes: tuple[str, ...] = tuple(PSP_CODES)
    gates: tuple[tuple[str, str], ...] = (("otp", REJECT_OTP), ("promotional", REJECT_PROMO), ("not a completed txn", REJECT_NOT_YET), ("informational", REJECT_INFO_ONLY))
    debit_words: tuple[str, ...] = tuple(DEBIT_WORDS)
    credit_words: tuple[str, ...] = tuple(CREDIT_WORDS)
    merchant_patterns: tuple[str, ...] = tuple(MERCHANT_PATTERNS)


DEFAULT = Rules()
