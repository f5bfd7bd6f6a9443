"""Word lists, patterns, formats and constants that results depend on."""

# Field patterns, tried in order; group 1 is the value.
PATTERNS = {
    "invoice_number": [
        r"(?i)(?:invoice\s*(?:number|num|no|#)|inv\s*(?:number|num|no|#)|bill\s*(?:number|num|no|#)|b\.?\s*no\.?|memo\s*(?:no|#)?|ref\s*(?:number|num|no|#))[\s.:\-_]*([A-Z0-9\-_/]{2,25})",
        r"(?i)(?:invoice|inv|bill|receipt|factura)[\s#.:\-_]+([A-Z0-9\-_/]{2,25})",
        r"(?i)#\s*([A-Z0-9\-_]{3,20})",
    ],
    "invoice_date": [
        r"\b(20\d{2}[-/.]\d{1,2}[-/.]\d{1,2})\b",
        r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b",
        r"\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{2,4})\b",
        r"\b(\d{1,2}\s+(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember))\s+\d{2,4})\b",
    ],
    "total_amount": [
        r"(?i)(?:total|grand\s*total|balance\s*due|amount\s*due|net\s*payable|total\s*usd|total\s*eur)[\s:$€£₹]*([\d,]+(?:\.\d{1,2})?)\b",
        r"(?i)(?:total|amount\s*due)[\s:]*([$€£₹]\s*[\d,]+(?:\.\d{1,2})?)\b",
    ],
    "balance_amount": [r"(?i)(?:balance|bal)[\s\S]{0,15}?([\d,]+(?:\.\d{1,2})?)\b"],
    "subtotal": [r"(?i)(?:subtotal|sub\s*total|net\s*amount)[\s:$€£₹]*([\d,]+(?:\.\d{1,2})?)\b"],
    "tax_amount": [r"(?i)(?:tax|vat|gst|sales\s*tax|hst)[\s:(%0-9)]*[\s:$€£₹]*([\d,]+(?:\.\d{1,2})?)\b"],
    "customer_name": [r"(?i)(?:customer\s*name|client\s*name|bill\s*to|sold\s*to|m/s|name)[\s.:\-_]+([A-Za-z0-9\s.\-_/]{3,50})"],
    "bank_name": [r"(?i)(?:bank\s*name|bank)[\s.:\-_]+([A-Za-z0-9\s.()]{3,40})"],
    "account_number": [r"(?i)(?:a/c\s*(?:no|num|number|numer)?|account\s*(?:no|number)?)[\s.:\-_]*([0-9]{8,20})"],
    "ifsc_code": [r"(?i)(?:ifsc|ifsc\s*code)[\s.:\-_]*([A-Z]{4}0[A-Z0-9]{6})"],
    "email": [r"\b([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b"],
    "phone": [
        r"(\+?\d{1,3}[-.\s]?(?:\(?\d{3}\)?[-.\s]?|\d{3}[-.\s]?)\d{3}[-.\s]?\d{4})",
        r"(?i)(?:mo|mobile|phone|tel)[\s.:\-_]*(\+?[0-9]{10,14})",
        r"(\+?[0-9]{10,14})",
    ],
}
TOTAL_FALLBACK = r"(?i)(?:total|grand\s*total|net\s*payable)[\s\S]{0,60}?([\d,]+\.\d{2})\b"
CONFIDENCE = {
    "vendor_name": 0.91, "invoice_number": 0.92, "invoice_date": 0.90, "total_amount": 0.94, "balance_amount": 0.89, "subtotal": 0.88, "tax_amount": 0.88,
    "customer_name": 0.88, "bank_name": 0.89, "account_number": 0.91, "ifsc_code": 0.95, "email": 0.96, "phone": 0.85, "total_fallback": 0.92,
}
# Fixed value: confidence of a key and value of a line.
LINE_PAIR = 0.90
# What a field is called.
FIELD_NAMES = {
    "vendor_name": "Vendor Name", "invoice_number": "Invoice Number", "invoice_date": "Invoice Date", "total_amount": "Total Amount", "balance_amount": "Balance Amount",
    "subtotal": "Subtotal", "tax_amount": "Tax Amount", "customer_name": "Customer Name", "bank_name": "Bank Name", "account_number": "Account Number",
    "ifsc_code": "IFSC Code", "email": "Email Address", "phone": "Phone Number",
}
# Words in lower case of which a line must have one for a pattern of the field to match; a field that is not listed has no such words.
HINTS = {
    "invoice_number": ["inv", "bill", "no", "memo", "ref", "receipt", "factura", "#"],
    "total_amount": ["total", "due", "payable"],
    "balance_amount": ["bal"],
    "subtotal": ["sub", "net"],
    "tax_amount": ["tax", "vat", "gst", "hst"],
    "customer_name": ["name", "bill", "sold", "m/s"],
    "bank_name": ["bank"],
    "account_number": ["a/c", "account"],
    "ifsc_code": ["ifsc"],
    "email": ["@"],
}
#: Every date's pattern needs digits around a separator or the beginning of a month's name.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Words that are no invoice number, and no customer; words of a vendor's line.
NOT_A_NUMBER = ["number", "no", "num", "id", "date", "total", "code"]
NOT_A_CUSTOMER = ["number", "date", "address", "phone"]
VENDOR_WORDS = ["traders", "store", "shop", "enterprise", "ltd", "pvt", "company", "market", "corp", "agency", "inc"]
# Words in a text that tell its type, in order.
TYPE_WORDS = {
    "invoice": ["invoice", "tax invoice", "bill to", "due date", "bill of supply", "debit memo", "cash memo"],
    "receipt": ["receipt", "pos", "terminal", "subtotal"],
    "id_card": ["identity", "license", "passport", "dob", "pan", "aadhaar"],
}
# Words in a key that fill a field, in order.
KEY_WORDS = {
    "invoice_number": ["invoice", "inv", "bill", "b.no", "bno"],
    "invoice_date": ["date", "dt"],
    "total_amount": ["total", "10tal", "net amount", "grand total", "payable", "balance"],
    "customer_name": ["name", "customer", "buyer", "sold to"],
    "bank_name": ["bank"],
    "account_number": ["a/c", "account"],
    "ifsc_code": ["ifsc"],
    "phone": ["mo", "mobile", "phone"],
}
# Words in a question that show what is asked, and in a line that answers it, in order.
ASKS_AMOUNT = ["total", "amount", "price", "cost", "balance", "due", "subtotal", "tax"]
SHOWS_AMOUNT = ["total", "amount", "balance", "due", "net", "tax", "rs", "$", "€", "₹"]
AMOUNT = r"[\$€£₹]?\s?\d+[\d,]*\.?\d{0,2}"
ASKS_DATE = ["date", "due date", "when", "day", "month", "year"]
SHOWS_DATE = ["date", "dated", "due", "issued", "valid"]
DATE = r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4})\b"
ASKS_NUMBER = ["number", "invoice", "id", "bill", "reference", "code", "no"]
SHOWS_NUMBER = ["invoice", "bill", "no", "number", "ref", "id #", "inv"]
ASKS_PARTY = ["who", "vendor", "seller", "company", "issuer", "merchant", "provider", "from"]
SHOWS_PARTY = ["Vendor Name:", "Merchant:"]
ASKS_SUMMARY = ["summary", "summarize", "what is this", "overview", "describe", "about"]
# Date formats, tried in order.
DATE_FORMATS = [
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "M-d-yyyy", "M/d/yyyy",
    "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy",
]
# Accepted files and their first bytes.
EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"]
SIGNATURES = {"pdf": b"%PDF", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "tiff_le": b"II*\x00", "tiff_be": b"MM\x00*", "bmp": b"BM", "webp": b"RIFF"}
MAX_BYTES = 25 * 1024 * 1024
# Fixed value: how a message names a document.
DOCUMENT_TAG = r"doc_id:\s*(\S+)"
# Texts of answers and results.
SUMMARY_HEADING = "Structured Document Entities:\n"
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
SAYS_AMOUNT = "Based on page {page}, the relevant figure found is **{text}**."
SAYS_DATE = "According to page {page}, the date specified is **{text}**."
SAYS_NUMBER = "From page {page}, the document specifies: **{text}**."
SAYS_ISSUER = "The issuer identified on page {page} is **{text}**."
SAYS_PARTY = "Based on page {page}, the relevant organization is **{text}**."
SAYS_SUMMARY = "Document Summary & Key Findings:\n{text}"
SAYS_POINT = "• **(Page {page})**: {text}"
SAYS_PASSAGE = 'Based on the document context (Page {page}):\n\n"{text}"'
SAYS_NOTHING = "No relevant document information found for doc_id '{text}'. Please make sure the document has been ingested or processed through OCR."
SAYS_ASK = "Please ask a question regarding the document."
SAYS_UNLOADED = "Custom Model response to: '{text}'. No documents are currently loaded. Ingest a document or run OCR to start querying document contents."
# Chunk and score constants.
PARAGRAPH_CHARS, WINDOW_WORDS, STEP_WORDS, LEAST_CHARS = 300, 40, 30, 10
DIMENSION, PROJECTIONS = 384, 128
DENSE_SHARE, LEXICAL_SHARE, NUMBER_BONUS = 0.55, 0.35, 0.2
