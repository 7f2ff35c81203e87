"""What a finding means, in a sentence or two: by subcategory, with values from the text (mostly hidden) and what to do.

An explanation is an opening, the details that the text has, the kind of document, and advice, all from the table below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.text import context_of, first_line, first_match, hidden, once

# What is looked for in a text, first match, in any case.
VALUES = {
    "name": r"(?:Name|name)[:\s]+([A-Z][a-z]+ [A-Z][a-z]+)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"[\(]?\d{3}[\)]?[\s.-]\d{3}[\s.-]\d{4}",
    "dob": r"(?:DOB|Date of Birth|dob)[:\s]+[\d/.-]+",
    "api_key": r"(?:sk_live_|sk_test_|AKIA|ghp_|xoxb-|SG\.|rk_live_|npm_)[A-Za-z0-9_/+=.-]{8,}",
    "password": r"(?:password|passwd|pass|pwd)[=:\s]+['\"]?([^\s'\"]{4,40})",
    "token": r"(?:token|bearer|auth)[=:\s]+['\"]?([A-Za-z0-9_/+=.-]{10,})",
    "conn_string": r"(?:postgres|mysql|mongodb|redis)://[^\s]{10,80}",
    "amount": r"\$[\d,]+(?:\.\d{2})?",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "routing": r"(?:routing|ABA)[:\s#]+(\d{9})",
    "account": r"(?:account|acct)[:\s#]+[\d-]{6,}",
    "diagnosis": r"(?:diagnosis|dx|assessment)[:\s]+(.{10,80})",
    "patient": r"(?:patient|name)[:\s]+([A-Z][a-z]+ [A-Z][a-z]+)",
    "medication": r"(?:rx|prescription|medication)[:\s]+(.{5,60})",
    "marking": r"(TOP SECRET|SECRET|CONFIDENTIAL|RESTRICTED|NOFORN|SCI|FOUO)",
}

STEAL, ROTATE, PAY, HEALTH = "It helps to steal an identity", "Replace it at once and keep its successor out of files", "It allows payments in someone else's name", "Health data, protected by law"
#: By subcategory: opening, details (each left out where the text lacks its value) and advice.
SENTENCES: dict[str, tuple[str, list[str], str]] = {
    "pii.identity": ("Data that identifies a person", ["{name}", "social security number {ssn}", "{dob}"], STEAL),
    "pii.contact": ("Contact data of a person", ["address {email}", "number {phone}"], "It opens the way to fraud by mail or phone"),
    "pii.government_id": ("Number of an official document", ["{ssn}"], STEAL),
    "pii.biometric": ("Measurements of a body", [], "They can't be changed once known"),
    "pii.behavioral": ("Record of what a person does", [], "Habits tell who someone is"),
    "pii.metadata": ("Hidden data about a person", ["address {email}"], "Take it out before the file is passed on"),
    "credentials.password": ("Password in plain text", ["{password}"], ROTATE),
    "credentials.api_key": ("Key of a service", ["{api_key}"], ROTATE),
    "credentials.private_key": ("Private key of a cipher", [], "Whoever has it can sign and decrypt; replace it"),
    "credentials.connection_string": ("Address of a database with its login", ["{conn_string}"], ROTATE),
    "credentials.token": ("Token of a session or login", ["{token}"], ROTATE),
    "credentials.cloud_config": ("Login of a cloud account", ["{api_key}"], ROTATE),
    "credentials.cicd": ("Login of a build system", ["{token}"], "Builds could be tampered with; replace it"),
    "credentials.container": ("Login of a container registry", ["{token}"], "Images could be replaced; replace it"),
    "financial.transaction": ("Payment or transfer", ["amount {amount}", "{account}"], "It tells who pays whom"),
    "financial.bank_account": ("Bank account", ["{routing}", "{account}"], PAY),
    "financial.credit_card": ("Number of a payment card", ["{credit_card}"], PAY),
    "financial.tax": ("Tax record", ["amount {amount}", "social security number {ssn}"], "Income and identity in one place"),
    "medical.diagnosis": ("Diagnosis of a patient", ["{diagnosis}", "{patient}"], HEALTH),
    "medical.prescription": ("Medicines of a patient", ["{medication}", "{patient}"], HEALTH),
    "medical.lab_result": ("Findings of a laboratory", ["{patient}"], HEALTH),
    "medical.lab_results": ("Findings of a laboratory", ["{patient}"], HEALTH),
    "medical.insurance": ("Health insurance of a person", ["{patient}"], HEALTH),
    "malicious.injection": ("Code or query slipped into an input", ["{payload}"], "Check every place that takes this input"),
    "malicious.exploit": ("Attack on a known weakness", ["{payload}"], "Check whether the weakness is mended here"),
    "malicious.malware": ("Sign of harmful software", ["{payload}"], "Isolate what ran it"),
    "malicious.phishing": ("Message that lures its reader", ["{payload}"], "Warn those who got it"),
    "malicious.prompt_injection": ("Text that gives orders to a language model", ["{payload}"], "Don't hand it to a model as instructions"),
    "malicious.supply_chain": ("Package that isn't what it says", ["{payload}"], "Take it out and check what depends on it"),
    "malicious.shell": ("Shell opened to a stranger", ["{payload}"], "Isolate what ran it"),
    "malicious.xxe": ("XML that fetches other files", ["{payload}"], "Turn external entities off"),
    "malicious.ssti": ("Template that runs code", ["{payload}"], "Never render what users write"),
    "malicious.ssrf": ("Request that reaches inner services", ["{payload}"], "Limit where the server may connect to"),
    "malicious.deserialization": ("Object that runs code when it is loaded", ["{payload}"], "Load only plain data"),
    "malicious.redos": ("Pattern that takes endless time", ["{payload}"], "Bound what the pattern may read"),
    "malicious.steganography": ("Data hidden in a picture or sound", ["{payload}"], "Look at what is hidden"),
    "malicious.prototype_pollution": ("Change of what all objects inherit", ["{payload}"], "Copy only known keys"),
    "confidential.classified": ("Classified document", ["marked {marking}", "{first_line}"], "Only for those cleared for it"),
    "confidential.internal": ("Paper of a company's own", ["{first_line}"], "Not meant for others"),
    "confidential.military": ("Military matters", ["{first_line}"], "Subject to export control"),
    "confidential.military_comms": ("Military orders or messages", ["marked {marking}", "{first_line}"], "Only for those cleared for it"),
    "confidential.weapons_systems": ("Details of weapons", ["{first_line}"], "Subject to export control"),
    "confidential.intelligence": ("Report of an intelligence service", ["marked {marking}", "{first_line}"], "Only for those cleared for it"),
    "confidential.nuclear": ("Nuclear plants or weapons", ["{first_line}"], "Restricted by law"),
    "confidential.geospatial": ("Places that shouldn't be known", ["{first_line}"], "It tells where something can be struck"),
    "confidential.education": ("Record of a pupil or student", ["{first_line}"], "Needs consent to be passed on"),
}
#: Of other subcategories, by category; {kind} is the subcategory's last part, in words.
OTHERS: dict[str, tuple[str, list[str], str]] = {
    "pii": ("Personal data ({kind})", ["{name}"], "Keep it from others"),
    "credentials": ("Login data ({kind})", [], ROTATE),
    "financial": ("Financial data ({kind})", ["amount {amount}"], "Keep it from others"),
    "medical": ("Medical data ({kind})", ["{patient}"], HEALTH),
    "malicious": ("Hostile content ({kind})", ["{payload}"], "Find out where it came from"),
    "confidential": ("Confidential content ({kind})", ["{first_line}"], "Not meant for others"),
    "safe": ("Nothing of concern ({kind})", ["{first_line}"], "No action needed"),
}
#: Characters of a payload that are shown; evidence of at most this many is no payload, and the first line stands for it.
PAYLOAD, LEAST_PAYLOAD = 100, 10


def _sentence(sentence: tuple[str, list[str], str]) -> Column:
    opening, details, advice = sentence
    pieces = [d.removesuffix("}").split("{") for d in details]
    listed = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(name).alias("value")) for before, name in pieces]).cast("array<struct<before:string,value:string>>")
    return F.struct(F.lit(opening).alias("opening"), listed.alias("details"), F.lit(advice).alias("advice"))


def _table(sentences: dict[str, tuple[str, list[str], str]]) -> Column:
    return F.create_map(*[y for s, x in sentences.items() for y in (F.lit(s), _sentence(x))])


def _hiding(label: str):
    return lambda value: hidden(value, label)


def explanation(subcategory: Column, text: Column, evidence: Column | None = None) -> Column:
    """What a finding of this subcategory in this text means; null for a null subcategory.

    A null or empty text gives no details. Subcategories that aren't known are told by their category, others as content of
    that name. Values are the first of their kind in the whole text; numbers, keys and passwords are hidden but for their ends.
    Only what the sentence asks for is looked for.
    """
    seen = F.lit(None).cast("string") if evidence is None else evidence
    kind = F.replace(F.substring_index(subcategory, ".", -1), F.lit("_"), F.lit(" "))

    def told(x: Column, line: Column) -> Column:
        shown_line = F.when(F.trim(line) != "", line)
        found = {k: once(first_match(text, p), _hiding(k)) for k, p in VALUES.items()}
        found["marking"] = F.upper(found["marking"])
        found["first_line"] = shown_line
        found["payload"] = F.when(F.length(seen) > LEAST_PAYLOAD, F.replace(F.substring(seen, 1, PAYLOAD), F.lit("\n"), F.lit(" "))).otherwise(shown_line)
        wanted = lambda k: F.exists(x["details"], lambda d: d["value"] == k)
        values = F.create_map(*[y for k, v in found.items() for y in (F.lit(k), F.when(wanted(k), v))])
        # A detail without its value is null and drops out.
        shown = once(values, lambda v: F.concat_ws("; ", F.transform(x["details"], lambda d: F.concat(d["before"], F.try_element_at(v, d["value"])))))
        head = once(shown, lambda y: F.concat(F.replace(x["opening"], F.lit("{kind}"), kind), F.when(y != "", F.concat(F.lit(": "), y)).otherwise("")))
        place = once(F.coalesce(context_of(line), F.lit("")), lambda c: F.when(c != "", F.concat(F.lit("Found in "), c)))
        return F.concat(F.concat_ws(". ", head, place, x["advice"]), F.lit("."))

    category = F.substring_index(subcategory, ".", 1)
    chosen = F.coalesce(F.try_element_at(_table(SENTENCES), subcategory), F.try_element_at(_table(OTHERS), category), _sentence(("Content of the kind {kind}", [], "Look at it")))
    return F.when(subcategory.isNotNull(), once(chosen, lambda x: once(first_line(text), lambda line: told(x, line))))
