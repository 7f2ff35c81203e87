"""Labels for raw sources, by keywords and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import count_hits, count_in, keyword_hits, once
from siftstone.schema import FINDINGS, finding

# Word lists and patterns by source, and the classes they stand for.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
AMOUNT = r"\$[\d,]+(?:\.\d{2})?"
PASSWORD = r"(?i)(?:password|passwd|pwd)\s*[:=]\s*\S+"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
URL = r"https?://\S+"
TAX_WORDS = ["income tax", "tax expense", "deferred tax", "tax rate", "tax provision", "tax benefit", "tax liability", "tax credit", "tax reform", "tax law", "irs", "internal revenue"]
FILING_SECTIONS = {"section_1A": ("financial.investment", "high"), "section_7": ("financial.investment", "high"), "section_7A": ("financial.investment", "medium"), "section_8": ("financial.bank_statement", "high"), "section_6": ("financial.bank_statement", "medium"), "section_11": ("financial.bank_statement", "medium")}
SECTION_CHARS = 4000
DEFENCE_TITLES = ["defense", "military", "army", "navy", "air force", "marine corps", "nuclear weapon", "missile defense", "nato", "intelligence", "cybersecurity", "homeland security", "national security", "dod", "pentagon", "weapons", "special operations", "drone", "space force", "indo-pacific", "counterterrorism", "classified", "arms control", "chemical weapon", "biological weapon"]
LEAST_CHARS = {"phishing": 30, "mail": 50, "spans": 50, "advisories": 50, "packages": 50, "controls": 100, "attacks": 100, "filings": 100, "transcriptions": 200, "payloads": 20, "injections": 10}
INTERNAL_WORDS = ["confidential", "do not distribute", "do not disclose", "internal only", "privileged", "attorney-client", "trade secret", "not for distribution", "document retention", "litigation hold", "executive committee"]
MONEY_WORDS = ["invoice", "payment", "wire transfer", "credit card", "bank account", "million", "billion", "settlement", "damages", "compensation"]
PHISHING_CRITICAL = ["verify your account", "confirm your identity", "suspended", "unauthorized access", "click here immediately", "within 24 hours", "credit card", "bank account", "social security"]
PHISHING_HIGH = ["urgent", "act now", "limited time", "password", "login", "update your", "verify your", "confirm your", "winner", "congratulations", "claim your prize"]
CLASSIFIED_WORDS = ["classified", "secret", "top secret", "controlled unclassified", "cui", "fouo", "for official use only", "sensitive but unclassified", "security clearance", "need to know", "compartmented", "national security", "defense information"]
ACCESS_WORDS = ["access control", "authentication", "authorization", "identity management", "multi-factor", "mfa", "password policy", "credential management", "pki", "certificate authority", "key management", "token", "single sign-on", "sso", "privileged access"]
WEAKNESS_WORDS = ["vulnerability", "exploit", "attack vector", "threat actor", "malware", "ransomware", "zero-day", "cve-", "penetration test", "red team", "adversary", "intrusion detection", "incident response"]
LOGIN_FAILURES = ["authentication failure", "failed password", "invalid user", "failed login", "access denied", "permission denied", "unauthorized"]
LOGIN_SOURCES = ["OpenSSH", "Linux"]
ATTACK_RULES = [
    ("malicious.injection", "critical", ["sql injection", "xss", "cross-site scripting", "command injection", "code injection", "ldap injection", "xpath injection", "nosql injection", "injection attack", "injection vulnerability", "owasp injection", "input validation", "parameterized", "prepared statement"]),
    ("malicious.ssrf", "high", ["ssrf", "server-side request forgery", "server side request forgery", "internal network", "metadata endpoint", "cloud metadata", "request forgery"]),
    ("malicious.ssti", "high", ["ssti", "server-side template injection", "server side template injection", "template injection", "jinja2", "freemarker", "twig injection", "template engine"]),
    ("malicious.shell", "critical", ["reverse shell", "web shell", "backdoor", "remote code execution", "rce", "command execution", "privilege escalation", "rootkit", "bind shell", "payload execution", "post-exploitation", "lateral movement", "persistence mechanism"]),
    ("malicious.obfuscation", "high", ["obfuscation", "encoding bypass", "evasion", "anti-detection", "polymorphic", "metamorphic", "packing", "crypter", "anti-forensic", "log tampering", "defense evasion", "steganography", "covert channel"]),
    ("malicious.phishing", "high", ["phishing", "social engineering", "spear phishing", "whaling", "credential harvesting", "pretexting", "vishing", "smishing", "business email compromise", "bec"]),
    ("malicious.supply_chain", "critical", ["supply chain", "dependency confusion", "typosquatting", "package hijack", "compromised library", "third-party risk", "software composition", "sca", "sbom"]),
    ("malicious.prompt_injection", "high", ["prompt injection", "llm attack", "ai safety", "jailbreak", "adversarial prompt", "indirect prompt injection"]),
]


def every(text: Column, pattern: str) -> Column:
    """Distinct matches in order of their characters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


def joined(values: Column, most: int) -> Column:
    return F.array_join(F.slice(values, 1, most), ", ")


def mail_findings(message: Column) -> Column:
    """Findings of an e-mail: identity, contact, password, internal marks, money; none if nothing is found.

    Phones, internal marks and money words count in the body, the rest anywhere.
    """
    body = F.coalesce(F.get(F.split(message, "\n\n", 2), F.lit(1)), F.lit(""))
    ssn, phone, amount, password = every(message, SSN), every(body, PHONE), every(message, AMOUNT), every(message, PASSWORD)
    mail = F.filter(every(message, EMAIL), lambda m: ~(m.endswith(".gif") | m.endswith(".jpg")))
    internal, money = keyword_hits(body, INTERNAL_WORDS), keyword_hits(body, MONEY_WORDS)
    some = lambda **fields: F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v != "")
    make = lambda sub, severity, extracted: finding(F.lit(sub.split(".")[0]), F.lit(sub), F.lit(sub), F.lit(severity), F.lit("labelling"), extracted)
    parts = [
        F.when(F.size(ssn) > 0, make("pii.identity", "critical", some(ssn=joined(ssn, 5)))),
        F.when((F.size(mail) > 0) | (F.size(phone) > 0), make("pii.contact", "medium", some(email=joined(mail, 5), phone=joined(phone, 3)))),
        F.when(F.size(password) > 0, make("credentials.password", "critical", some(password=joined(password, 3)))),
        F.when(F.size(internal) > 0, make("confidential.internal", "high", some(markers=joined(internal, 20)))),
        F.when((F.size(money) > 0) & (F.size(amount) > 0), make("financial.transaction", "high", some(amounts=joined(amount, 5), keywords=joined(money, 20)))),
    ]
    return F.array_compact(F.array(*parts)).cast(FINDINGS)


def phishing_label(text: Column, is_phishing: Column) -> Column:
    """struct<subcategory, severity, indicators, urls> of a message known to be phishing or not."""
    critical, high = keyword_hits(text, PHISHING_CRITICAL), keyword_hits(text, PHISHING_HIGH)
    urls = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)))
    shown = F.when(F.size(critical) > 0, critical).otherwise(high)
    bad = F.struct(F.lit("malicious.phishing").alias("subcategory"), F.when(F.size(critical) > 0, "critical").otherwise("high").alias("severity"), joined(shown, 3).alias("indicators"), urls.alias("urls"))
    good = F.struct(F.lit("safe.documentation").alias("subcategory"), F.lit("info").alias("severity"), F.lit("").alias("indicators"), F.lit(0).alias("urls"))
    return F.when(is_phishing, bad).otherwise(good)


def standards_label(text: Column) -> Column:
    """struct<subcategory, severity> of a standards document: two words of a list decide, the first list first."""
    secret = F.struct(F.lit("confidential.classified").alias("subcategory"), F.lit("high").alias("severity"))
    guarded = F.struct(F.lit("confidential.classified").alias("subcategory"), F.lit("medium").alias("severity"))
    plain = F.struct(F.lit("safe.documentation").alias("subcategory"), F.lit("info").alias("severity"))
    return F.when(count_hits(text, CLASSIFIED_WORDS) >= 2, secret).when((count_hits(text, WEAKNESS_WORDS) >= 2) | (count_hits(text, ACCESS_WORDS) >= 2), guarded).otherwise(plain)


def log_label(lines: Column, source: Column) -> Column:
    """struct<subcategory, severity, failures, addresses> of a window of log lines."""
    text = F.array_join(lines, "\n")
    failures = count_hits(text, LOGIN_FAILURES)
    bad = (failures >= 2) | ((failures >= 1) & source.isin(LOGIN_SOURCES))
    return F.struct(F.when(bad, "pii.metadata").otherwise("safe.config").alias("subcategory"), F.when(bad, "medium").otherwise("info").alias("severity"), failures.alias("failures"), F.size(every(text, IP)).alias("addresses"))


def attack_label(text: Column) -> Column:
    """struct<n, subcategory, severity> of the rule with most of its words in the text, the first among equals; null without any."""
    scores = lambda low: F.array(*[F.struct(count_in(low, words).alias("n"), F.lit(-k).alias("k"), F.lit(sub).alias("subcategory"), F.lit(severity).alias("severity")) for k, (sub, severity, words) in enumerate(ATTACK_RULES)])
    shown = lambda best: F.when(best["n"] > 0, F.struct(best["n"].alias("n"), best["subcategory"].alias("subcategory"), best["severity"].alias("severity")))
    return once(F.array_max(once(F.lower(text), scores)), shown)


def cve_rows(feed: DataFrame) -> DataFrame:
    """(id, text, severity, cwes) of a feed with an array `vulnerabilities`: English description, newest score version first."""
    cve = feed.select(F.explode("vulnerabilities.cve").alias("c"))
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    base = lambda version: F.get(F.col(f"c.metrics.{version}"), F.lit(0))["cvssData"]["baseSeverity"]
    severity = F.when(F.upper(F.coalesce(base("cvssMetricV31"), base("cvssMetricV30"), base("cvssMetricV2"))).isin("HIGH", "CRITICAL"), "critical").otherwise("medium")
    codes = F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    return cve.select(F.col("c.id").alias("id"), english.alias("text"), severity.alias("severity"), codes.alias("cwes")).where("text IS NOT NULL")


def span_rows(records: DataFrame, labels: dict[str, str], raised: list[str], least: int = 50) -> DataFrame:
    """(text, subcategory, severity, shown) of records (source_text, language, privacy_mask array<struct<label, value>>): English, `least` characters."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    rows = records.where((F.coalesce("language", F.lit("en")) == "en") & (F.length("source_text") >= least))
    spans = rows.select("source_text", F.explode("privacy_mask").alias("m")).withColumn("subcategory", F.try_element_at(table, F.col("m.label"))).where("subcategory IS NOT NULL")
    made = spans.groupBy("source_text", "subcategory").agg(F.slice(F.array_sort(F.collect_set("m.value")), 1, 5).alias("shown"), F.max(F.col("m.label").isin(raised)).alias("raised"))
    return made.select(F.col("source_text").alias("text"), "subcategory", F.when(F.col("raised"), "critical").otherwise("medium").alias("severity"), "shown")


def filing_sections(filings: DataFrame, sections: dict[str, str], least: int = 100) -> DataFrame:
    """(filename, section, subcategory, text): one row a section column that holds a real text."""
    rows = filings.unpivot(["filename"], list(sections), "section", "text")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in sections.items() for x in kv]), F.col("section"))
    head = F.lower(F.substring("text", 1, 100))
    return rows.where((F.length("text") >= least) & ~head.contains("not applicable") & ~head.contains("omitted")).select("filename", "section", label.alias("subcategory"), "text")


def filing_findings(filings: DataFrame, sections: dict[str, tuple[str, str]] = FILING_SECTIONS) -> DataFrame:
    """(filename, section, text, subcategory, severity, tax_terms): real sections, each with a class and severity of its own.

    A text is a section's first 4,000 characters. Two tax terms or more in it make it financial.tax of high severity, whatever
    the section. Columns that `filings` lacks are passed over; null and short sections give no row, repeated filings one each.
    """
    there = {c: v for c, v in sections.items() if c in filings.columns}
    severity = F.element_at(F.create_map(*[F.lit(x) for c, (_, v) in there.items() for x in (c, v)]), F.col("section"))
    rows = filing_sections(filings, {c: v for c, (v, _) in there.items()}).withColumn("text", F.substring("text", 1, SECTION_CHARS))
    rows = rows.withColumn("tax_terms", keyword_hits(F.col("text"), TAX_WORDS))
    tax = F.size("tax_terms") >= 2
    return rows.select("filename", "section", "text", F.when(tax, "financial.tax").otherwise(F.col("subcategory")).alias("subcategory"), F.when(tax, "high").otherwise(severity).alias("severity"), "tax_terms")


def titled(reports: DataFrame, words: list[str] = DEFENCE_TITLES, title: str = "title", first: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Reports whose title holds one of the words, in any case; of these `most`, the least by the columns of `first` (needed then). A null title holds none."""
    low = F.lower(F.col(title))
    rows = reports.where(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)))
    if most is None:
        return rows
    if not first:
        raise ValueError("a limit needs columns to order by")
    return rows.orderBy(*first).limit(most)


def long_enough(rows: DataFrame, feed: str, text: str = "text") -> DataFrame:
    """Rows whose text has the least number of characters that its feed asks for; null has none."""
    return rows.where(F.length(text) >= LEAST_CHARS[feed])


def wrapped_payloads(lines: DataFrame, templates: dict[str, list[str]], kind: str) -> DataFrame:
    """(payload, text): each line that is no comment in one of its kind's templates ("{payload}"), chosen by hash."""
    choices = templates[kind]
    at = F.pmod(F.crc32("value"), F.lit(len(choices))).cast("int")
    rows = lines.where((F.trim("value") != "") & ~F.trim(F.col("value")).startswith("#"))
    return rows.select(F.col("value").alias("payload"), F.replace(F.element_at(F.array(*map(F.lit, choices)), at + 1), F.lit("{payload}"), F.col("value")).alias("text"))
