"""The patterns, word lists and constants that decide what counts as private.

These are contract values, stated once. Each pattern is written in a neutral
form and rendered for an engine: ``java()`` for Spark, ``re2()`` for the
DuckDB checks. ``%L%`` / ``%R%`` / ``%B%`` are ASCII word boundaries (before a
word, after a word, either) and ``%S%`` is the body of a white-space class,
because ``\\b`` and ``\\s`` mean different things in the two engines.
"""

from __future__ import annotations

# The characters ECMAScript counts as white space.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def java(pattern: str) -> str:
    return (
        pattern.replace("%L%", r"(?<!\w)")
        .replace("%R%", r"(?!\w)")
        .replace("%B%", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
        .replace("%S%", SPACE)
    )


def re2(pattern: str) -> str:
    return pattern.replace("%L%", r"\b").replace("%R%", r"\b").replace("%B%", r"\b").replace("%S%", SPACE)


# The ten categories, in order.
CATEGORIES = ("EMAIL", "PHONE", "NAME", "ADDRESS", "CARD", "GOV_ID", "ACCOUNT", "DOB", "FACE", "OTHER")
# Where a detection can come from.
SOURCES = ("regex", "ner", "vision", "dom-type")

# Fixed value: the token format.
TOKEN = "<PII:(" + "|".join(CATEGORIES) + r"):([0-9]+)>"
# Fixed value: any token-shaped text, known category or not.
ANY_TOKEN = r"<PII:([A-Z_]+):[0-9]+>"

# Detector patterns.
EMAIL = (
    r"(?i)%B%[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
    r"(?:\.[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?)+%R%"
)
PHONE = r"\+[0-9]{1,3}(?:[%S%.-]{0,3}[0-9]){7,12}%R%"
LOCAL_MOBILE = r"%L%0?[6-9](?:[ -]?[0-9]){9}%R%"
LABELLED_PHONE = r"%L%[0-9](?:[ .-]?[0-9]){7,11}%R%"
CARD = r"%L%[0-9](?:[ -]?[0-9]){12,18}%R%"
PAN = r"(?i)%L%[A-Z]{5}[0-9]{4}[A-Z]%R%"
IFSC = r"(?i)%L%[A-Z]{4}0[A-Z0-9]{6}%R%"
UPI_CORE = r"%L%[a-z0-9][a-z0-9._-]{1,80}@[a-z][a-z0-9]{1,30}"
UPI = "(?i)" + UPI_CORE + r"(?![a-z0-9-]|\.[a-z0-9])"
AADHAAR = r"%L%[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}%R%"
ACCOUNT_NUMBER = r"%L%[0-9]{8,18}%R%"
DATE = (
    r"(?i)%L%(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* (?:19|20)[0-9]{2})%R%"
)
PASSPORT = r"(?i)%L%[A-Z][0-9]{7}%R%"
OTHER_ID = r"(?i)%B%(?=[A-Z0-9-]*[0-9])[A-Z0-9-]{4,20}%B%"
OTHER_ID_PLAIN = r"(?i)%B%[A-Z0-9-]{4,20}%B%"

# The words that label a number.
NOT_A_PHONE = (
    r"(?i)%L%(?:order|invoice|tracking|awb|shipment|reference|ref|ticket|pnr|booking|transaction|txn|receipt"
    r"|serial|sku|isbn|account|a/c)[%S%]*(?:no\.?|number|id)?[%S%]*[:#.-]?[%S%]*\z"
)
PHONE_CONTEXT = r"(?i)%L%(?:phone|mobile|mob|cell|tel|telephone|whatsapp|landline|contact(?:[%S%]+(?:number|no))?)%R%"
AADHAAR_CONTEXT = r"(?i)aadhaar|aadhar|uidai|id[%S%]+card|identity[%S%]+card|national[%S%]+id|government[%S%]+id|govt\.?[%S%]+id"
ACCOUNT_CONTEXT = r"(?i)account(?:[%S%]+number|[%S%]+no\.?|#)?"
DOB_CONTEXT = r"(?i)date of birth|birth ?date|%L%d\.?o\.?b%R%|%L%born%R%"
PASSPORT_CONTEXT = r"(?i)passport"
OTHER_ID_CONTEXT = r"(?i)(?:patient|member|customer|employee)[%S%]+id|policy[%S%]+(?:number|no\.?|#)|%L%mrn%R%"
# Fixed value: how far back a label may sit.
LABEL_WINDOW = 48
# Words that lead into an email address.
LEADS_INTO_ADDRESS = ("at", "to", "or", "and", "is", "via", "email", "e-mail", "mail", "contact", "me", "us")

# What a form field says it holds.
AUTOCOMPLETE_CATEGORY = {
    "name": "NAME",
    "given-name": "NAME",
    "additional-name": "NAME",
    "family-name": "NAME",
    "nickname": "NAME",
    "cc-name": "NAME",
    "username": "OTHER",
    "email": "EMAIL",
    "tel": "PHONE",
    "tel-national": "PHONE",
    "tel-local": "PHONE",
    "street-address": "ADDRESS",
    "address-line1": "ADDRESS",
    "address-line2": "ADDRESS",
    "address-line3": "ADDRESS",
    "postal-code": "ADDRESS",
    "cc-number": "CARD",
    "cc-csc": "CARD",
    "bday": "DOB",
    "one-time-code": "OTHER",
}
INPUT_TYPE_CATEGORY = {"email": "EMAIL", "tel": "PHONE"}
PASSWORD_AUTOCOMPLETE = r"%L%(current|new)-password%R%"

# Entity labels and what they map to, the names cutoff, and document words that are no names.
ENTITY_CATEGORY = {
    "person": "NAME",
    "name": "NAME",
    "address": "ADDRESS",
    "location": "ADDRESS",
    "employer": "OTHER",
    "company": "OTHER",
    "organization": "OTHER",
    "organisation": "OTHER",
}
NAME_LABELS = ("person", "address")
NAME_THRESHOLD = 0.6
NOT_NAMES = ("aadhaar", "aadhar", "uidai")
MAX_WORDS = 256
WORD = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|[^%S%]"
# The same for Python, whose word characters are letters, numbers and _ of any script.
PYTHON_WORD = r"\w+(?:[-_]\w+)*|[^" + SPACE + "]"
BUSINESS_WORD = r"%L%(?:clinic|branch|hospital|bank|restaurant|store)%R%"
STREET_WORD = (
    r"(?:road|rd|street|st|lane|ln|marg|nagar|colony|layout|avenue|ave|cross|main|circle|chowk|gali|bazaar"
    r"|block|sector)%R%"
)
BUSINESS_NOT_STREET = "(?i)" + BUSINESS_WORD + r"(?![%S%]+" + STREET_WORD + ")"
BUSINESS_AND_STREET = "(?i)" + BUSINESS_WORD + r"[%S%]+" + STREET_WORD
HOME_CUE = (
    r"(?i)%L%(?:near|opp|opposite|behind|beside|next to|flat|house|apartment|apt|floor|plot|door)%R%"
    r"|^[%S%]*#?[0-9]"
)

# Words that address the user.
CUES = (
    r"hello|hi|hey|dear|welcome(?: back)?|good (?:morning|afternoon|evening)|signed in as|logged in as"
    r"|my name is|i am|i'm|deliver(?:ing)? to|ship(?:ping)? to|bill(?:ing)? to"
)
CUE_BEFORE = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + CUES + r")[%S%,:!-]*\z"
CUE_MENTION = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + CUES + r")(?![\p{L}\p{N}])"
CUE_MENTION_RE2 = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + CUES + r")(?:[^\p{L}\p{N}]|\z)"
NAME_LOCAL_PART = r"(?i)^[a-z]{2,}(?:[._-][a-z]{2,})+\z"
MIN_KNOWN_LENGTH = 3
SHORT_TEXT = 40

# The four near-certain kinds of the outbound scan.
SCAN_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SCAN_PAN = r"%L%[A-Z]{5}[0-9]{4}[A-Z]%R%"
SCAN_PHONE = r"\+[0-9][0-9%S%-]{9,17}[0-9]"
SCAN_CARD = r"%L%(?:[0-9][ -]?){12,18}[0-9]%R%"

# Url segment masks, in the order tested.
URL_MASKS = (
    (r"^[0-9]{3,}\z", "{id}"),
    (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-", "{uuid}"),
    (r"(?i)^[0-9a-f]{16,}\z", "{hash}"),
    (r"@", "{email}"),
    (r"[0-9]{4,}", "{id}"),
)

# Commitments a button can make, and the goal words that ask for them.
COMMITMENTS = (
    (
        "place an order or pay",
        r"%L%(place (?:your |the )?order|order now|buy now|buy|purchase|pay(?: now)?|checkout|check out"
        r"|proceed to (?:pay|payment|checkout)|confirm (?:order|payment|purchase))%R%",
        r"%L%(order|buy|purchase|pay|payment|checkout|check out)%R%",
    ),
    (
        "delete or remove something",
        r"%L%(delete|erase|discard)%R%|%L%remove (?:account|card|address|payment|item|from)%R%",
        r"%L%(delete|remove|erase|discard|clear)%R%",
    ),
    (
        "create an account",
        r"%L%(create (?:an |my |your )?account|sign[- ]?up|register|join now)%R%",
        r"%L%(create (?:an |my |a new )?account|sign[- ]?up(?![- ]?(?:form|page))|sign me up|register)%R%",
    ),
    (
        "subscribe, cancel or transfer money",
        r"%L%(subscribe|unsubscribe|cancel (?:order|subscription|booking|plan)|transfer|send money)%R%",
        r"%L%(subscribe|unsubscribe|cancel|transfer|send money)%R%",
    ),
    (
        "change a password or credentials",
        r"%L%(change password|update password|reset password|save (?:new )?password"
        r"|confirm (?:new )?password|set password)%R%",
        r"%L%(change|update|reset|set)%R%.{0,20}%L%password%R%",
    ),
    (
        "share, forward or send data to others",
        r"%L%(share (?:with|to|publicly)|forward(?: to)?|send to (?:others|contacts|email)"
        r"|publish(?: publicly)?|make public|export (?:and )?share)%R%",
        r"%L%(share|forward|publish|send to|make public)%R%",
    ),
    (
        "upload or submit a file or attachment",
        r"%L%(upload (?:and )?submit|send (?:file|attachment|document)|submit (?:form|application|document)"
        r"|attach (?:and )?send)%R%",
        r"%L%(upload|attach|send (?:file|document)|submit (?:form|application))%R%",
    ),
)

# Goal words that ask for each kind of data, and the kinds always checked.
ASKS_FOR = {
    "NAME": r"%L%names?%R%",
    "EMAIL": r"%L%e-?mails?%R%",
    "PHONE": r"%L%(?:phone|mobile|cell|whatsapp|telephone|contact number|my number)%R%",
    "ADDRESS": r"(?<!e-?mail[%S%])%L%address(?:es)?%R%|%L%(?:street|city|town|pin ?code|post ?code|postal code|zip)%R%",
    "CARD": r"%L%(?:card|credit|debit)%R%",
    "GOV_ID": r"%L%(?:pan|aadhaa?r|passport|ssn|social security|national id|voter id|driving licen[cs]e"
    r"|licen[cs]e number|id number|identity)%R%",
    "ACCOUNT": r"%L%(?:account (?:number|no)|bank account|a/c|ifsc|iban|customer (?:id|number))%R%",
    "DOB": r"%L%(?:birth|birthday|dob|born)%R%",
}
SENSITIVE = ("GOV_ID", "CARD", "ACCOUNT")

# Phrases that try to instruct the model, and the longest goal accepted.
INJECTION_RULES = (
    r"ignore (?:(?:all|previous|prior|above|the|your)[%S%]+)*instructions?",
    r"disregard (?:(?:all|previous|prior|the|your)[%S%]+)*instructions?",
    r"override (?:(?:all|previous|prior|the|your)[%S%]+)*instructions?",
    r"forget (?:everything|what you were told|your instructions|your previous|all previous)",
    r"new (?:task|instruction|directive|goal|objective)[%S%]*:",
    r"system[%S%]*[:-][%S%]*(?:prompt|message|instruction)",
    r"%L%you are now%R%",
    r"%L%you are (?:a |an )?(?:different|new|another|evil|uncensored)",
    r"%L%act as%R%.{0,40}%L%(?:assistant|ai|model|gpt|llm|bot)%R%",
    r"%L%pretend (?:you are|to be)%R%",
    r"%L%roleplay as%R%",
    r"%L%dan mode%R%",
    r"%L%jailbreak%R%",
    r"%L%do anything now%R%",
    r"%L%uncensored mode%R%",
    r"%L%developer mode%R%",
    r"%L%admin mode%R%",
    r"%L%PROMPT[%S%]*:",
    r"%L%INSTRUCTION[%S%]*:",
    r"\[[%S%]*system[%S%]*\]",
    r"decode (?:the following|this|and execute)",
    r"execute (?:the following|this) (?:code|command|instruction)",
)
MAX_GOAL_LENGTH = 500

# Wording of counts.
CATEGORY_WORDS = {
    "EMAIL": ("email address", "email addresses"),
    "PHONE": ("phone number", "phone numbers"),
    "NAME": ("name", "names"),
    "ADDRESS": ("address", "addresses"),
    "CARD": ("card number", "card numbers"),
    "GOV_ID": ("ID number", "ID numbers"),
    "ACCOUNT": ("account number", "account numbers"),
    "DOB": ("birth date", "birth dates"),
    "FACE": ("face", "faces"),
    "OTHER": ("private value", "private values"),
}

# Element roles, states and the finish codes of a task.
ROLES = (
    "button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "option", "slider",
    "tab", "menuitem", "heading", "text", "image", "table", "row", "cell", "list", "listitem", "form", "dialog",
    "region", "canvas", "iframe", "video", "other",
)
STATES = (
    "editable", "readonly", "disabled", "required", "invalid", "checked", "unchecked", "selected", "expanded",
    "collapsed", "focused", "offscreen",
)
CONTROL_ROLES = (
    "button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "listbox", "option", "slider",
    "tab", "menuitem", "dialog", "heading",
)
REPORTED_STATES = ("checked", "unchecked", "expanded", "collapsed", "selected", "disabled", "invalid")
ACTION_TYPES = ("click", "type", "scroll", "select", "navigate", "extract", "wait", "done")
PLACES = ("text", "field", "title", "canvas", "iframe", "image")
PIXEL_PLACES = ("canvas", "image", "iframe")
