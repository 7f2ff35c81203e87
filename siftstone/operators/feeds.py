"""Findings and texts from security feeds: advisories, malicious packages, attack catalogues, policy reports, injection sets, payload folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import count_hits, filled
from siftstone.operators.corpus import fingerprint
from siftstone.schema import FINDINGS, finding

# Weakness codes, ecosystems, words and folders, and what they stand for.
WEAKNESS_LABELS = {
    "CWE-79": "malicious.injection", "CWE-89": "malicious.injection", "CWE-78": "malicious.shell", "CWE-77": "malicious.shell", "CWE-94": "malicious.injection",
    "CWE-611": "malicious.xxe", "CWE-502": "malicious.deserialization", "CWE-918": "malicious.ssrf", "CWE-1321": "malicious.prototype_pollution",
    "CWE-1333": "malicious.redos", "CWE-400": "malicious.redos", "CWE-91": "malicious.injection", "CWE-90": "malicious.injection", "CWE-943": "malicious.injection",
    "CWE-434": "malicious.exploit", "CWE-22": "malicious.exploit", "CWE-352": "malicious.exploit", "CWE-287": "credentials.token", "CWE-798": "credentials.password",
    "CWE-522": "credentials.password", "CWE-200": "confidential.internal", "CWE-312": "credentials.password", "CWE-327": "credentials.token",
}
ECOSYSTEMS = ["npm", "pip", "PyPI", "RubyGems", "Go", "crates.io", "NuGet", "Maven"]
SUPPLY_WORDS = ["supply chain", "malicious package", "typosquat", "dependency confusion", "backdoor", "trojan", "malicious code in", "compromised"]
SUPPLY_WORDS_OF_ECOSYSTEMS = ["malicious", "backdoor", "trojan", "exfiltrat"]
PACKAGE_CRITICAL = ["backdoor", "reverse shell", "credential", "exfiltrat"]
PACKAGE_SHELL = ["reverse shell", "shell command", "os.system", "subprocess", "exec("]
PACKAGE_SECRETS = ["credential", "password", "token", "api key", "secret", "env var", ".env"]
CRITICAL_TACTICS = ["initial-access", "execution", "persistence", "privilege-escalation", "credential-access", "lateral-movement", "command-and-control", "exfiltration", "impact"]
WEAPON_WORDS = ["missile", "icbm", "ssbn", "submarine", "destroyer", "ddg", "frigate", "ffg", "carrier", "cvn", "aircraft", "fighter", "bomber", "f-35", "f-22", "b-21", "ngad", "thaad", "patriot", "aegis", "bmd", "ballistic missile defense", "hypersonic", "lrhw", "directed energy", "laser", "munitions", "torpedo", "abrams", "bradley", "stryker", "javelin", "sentinel", "minuteman", "columbia-class", "virginia-class", "ford-class", "constellation-class"]
NUCLEAR_WORDS = ["nuclear", "warhead", "nonproliferation", "arms control", "icbm", "triad", "new start", "nnsa", "stockpile", "nc3", "cnwdi", "enrichment", "centrifuge", "plutonium", "uranium", "fissile"]
INTELLIGENCE_WORDS = ["intelligence community", "dni", "cia", "nsa", "dia", "nro", "nga", "fisa", "surveillance", "counterintelligence", "cybercom", "cyber command", "sigint", "humint", "imint", "osint", "declassification", "classified", "covert action", "espionage"]
MILITARY_WORDS = ["special operations", "sof", "socom", "combatant command", "eucom", "indopacom", "centcom", "africom", "southcom", "northcom", "spacecom", "force structure", "ndaa", "defense budget", "acquisition", "brac", "readiness", "recruiting", "retention", "mobilization", "deployment", "military construction", "defense industrial base", "dod"]
MILITARY_FALLBACK = ["defense", "military", "army", "navy", "air force", "marine"]
PAYLOAD_FOLDERS = {
    "SQL Injection": ("malicious.injection", "critical"), "NoSQL Injection": ("malicious.injection", "critical"), "Command Injection": ("malicious.injection", "critical"), "LDAP Injection": ("malicious.injection", "high"),
    "GraphQL Injection": ("malicious.injection", "high"), "LaTeX Injection": ("malicious.injection", "medium"), "CRLF Injection": ("malicious.injection", "high"), "CSS Injection": ("malicious.injection", "medium"),
    "CSV Injection": ("malicious.injection", "medium"), "XSS Injection": ("malicious.injection", "high"), "File Inclusion": ("malicious.injection", "critical"), "Directory Traversal": ("malicious.injection", "high"),
    "HTTP Parameter Pollution": ("malicious.injection", "medium"), "Insecure Deserialization": ("malicious.injection", "critical"), "SAML Injection": ("malicious.injection", "high"), "Client Side Path Traversal": ("malicious.injection", "high"),
    "Server Side Request Forgery": ("malicious.ssrf", "high"), "DNS Rebinding": ("malicious.ssrf", "high"), "Server Side Template Injection": ("malicious.ssti", "high"), "Server Side Include Injection": ("malicious.ssti", "high"),
    "Upload Insecure Files": ("malicious.shell", "critical"), "CVE Exploits": ("malicious.shell", "critical"), "Java RMI": ("malicious.shell", "critical"), "Prompt Injection": ("malicious.prompt_injection", "high"),
    "Prototype Pollution": ("malicious.prototype_pollution", "high"), "Regular Expression": ("malicious.redos", "medium"), "Denial of Service": ("malicious.redos", "high"), "Encoding Transformations": ("malicious.obfuscation", "medium"),
    "Dependency Confusion": ("malicious.supply_chain", "critical"), "Cross-Site Request Forgery": ("malicious.injection", "high"), "Clickjacking": ("malicious.injection", "medium"), "DOM Clobbering": ("malicious.injection", "medium"),
    "Request Smuggling": ("malicious.injection", "high"), "Type Juggling": ("malicious.injection", "medium"), "Web Cache Deception": ("malicious.injection", "medium"), "Mass Assignment": ("malicious.injection", "high"),
    "Insecure Direct Object References": ("malicious.injection", "high"), "Race Condition": ("malicious.injection", "high"), "ORM Leak": ("malicious.injection", "medium"), "JSON Web Token": ("malicious.obfuscation", "high"),
    "OAuth Misconfiguration": ("malicious.obfuscation", "high"), "Open Redirect": ("malicious.phishing", "medium"), "Account Takeover": ("malicious.phishing", "critical"), "API Key Leaks": ("malicious.obfuscation", "high"), "Headless Browser": ("malicious.shell", "high"),
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _make(subcategory: Column, severity: Column, words: Column) -> Column:
    return finding(F.substring_index(subcategory, ".", 1), subcategory, words, severity, F.lit("labelling"))


def _has(text: Column, words: list[str]) -> Column:
    return count_hits(text, words) > 0


def advisory_findings(summary: Column, description: Column, severity: Column, codes: Column, ecosystems: Column) -> Column:
    """Supply-chain words, then each label of the weakness codes once in their order; an exploit if there is neither."""
    low = F.coalesce(description, F.lit(""))
    grade = F.when(severity.isin("critical", "high", "medium", "low"), severity).otherwise("medium")
    known = F.arrays_overlap(F.coalesce(ecosystems, F.array().cast("array<string>")), F.array(*map(F.lit, ECOSYSTEMS)))
    supply = _has(low, SUPPLY_WORDS) | _has(F.coalesce(summary, F.lit("")), SUPPLY_WORDS) | (known & _has(low, SUPPLY_WORDS_OF_ECOSYSTEMS))
    table = _map(WEAKNESS_LABELS)
    labels = F.array_distinct(F.array_compact(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.try_element_at(table, c))))
    labels = F.concat(F.when(supply, F.array(F.lit("malicious.supply_chain"))).otherwise(F.array().cast("array<string>")), labels)
    labels = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("malicious.exploit")))
    return F.transform(labels, lambda s: _make(s, grade, F.substring(F.coalesce(summary, F.lit("")), 1, 200))).cast(FINDINGS)


def advisory_text(advisories: DataFrame) -> DataFrame:
    """(id, text) of advisories (ghsa_id, cve_id, summary, severity, cvss_score, vulnerabilities, description)."""
    packages = F.transform(F.slice("vulnerabilities", 1, 5), lambda v: F.concat(F.lit("  - "), F.coalesce(v["ecosystem"], F.lit("unknown")), F.lit("/"), F.coalesce(v["package"], F.lit("unknown")), F.lit(" "), F.coalesce(v["vulnerable_range"], F.lit(""))))
    score = F.when(F.col("cvss_score").isNotNull(), F.concat(F.lit(" (CVSS "), F.col("cvss_score").cast("string"), F.lit(")"))).otherwise("")
    parts = [
        F.concat(F.lit("Security Advisory: "), "ghsa_id", F.when(F.col("cve_id").isNotNull(), F.concat(F.lit(" ("), "cve_id", F.lit(")"))).otherwise("")),
        F.concat(F.lit("\nSummary: "), "summary"),
        F.concat(F.lit("Severity: "), F.upper("severity"), score),
        F.when(F.size("vulnerabilities") > 0, F.concat(F.lit("\nAffected Packages:\n"), F.array_join(packages, "\n"))),
        F.concat(F.lit("\nDescription:\n"), "description"),
    ]
    return advisories.select(F.col("ghsa_id").alias("id"), F.concat_ws("\n", *parts).alias("text"))


def package_findings(summary: Column, details: Column) -> Column:
    """A malicious package is a supply-chain attack; words for shells and secrets add findings."""
    text = F.concat_ws(" ", summary, details)
    words = F.substring(F.coalesce(summary, F.lit("")), 1, 200)
    make = lambda sub, severity: _make(F.lit(sub), severity, words)
    parts = [make("malicious.supply_chain", F.when(_has(text, PACKAGE_CRITICAL), "critical").otherwise("high")), F.when(_has(text, PACKAGE_SHELL), make("malicious.shell", F.lit("critical"))), F.when(_has(text, PACKAGE_SECRETS), make("credentials.token", F.lit("critical")))]
    return F.array_compact(F.array(*parts)).cast(FINDINGS)


def attack_rows(bundles: DataFrame) -> DataFrame:
    """(name, technique_id, kind, subcategory, severity, text): the first described technique, malware or tool of each bundle of objects."""
    kinds = ["attack-pattern", "malware", "tool"]
    first = F.get(F.filter("objects", lambda o: o["type"].isin(kinds) & (F.coalesce(o["description"], F.lit("")) != "")), F.lit(0))
    rows = bundles.select(first.alias("o")).where("o IS NOT NULL")
    empty = F.array().cast("array<string>")
    technique = F.coalesce(F.get(F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"], F.lit(""))
    tactics = F.coalesce(F.transform("o.kill_chain_phases", lambda k: k["phase_name"]), empty)
    platforms = F.coalesce(F.col("o.x_mitre_platforms"), empty)
    critical = F.arrays_overlap(tactics, F.array(*map(F.lit, CRITICAL_TACTICS)))
    pattern = F.col("o.type") == "attack-pattern"
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value, F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# "), "o.name", F.lit("\n\n"), F.when(pattern, F.concat(line("Technique", technique), line("Tactics", F.array_join(tactics, ", ")))).otherwise(line("Type", F.col("o.type"))), line("Platforms", F.array_join(platforms, ", ")), F.lit("\n"), F.substring("o.description", 1, 3000))
    return rows.select(F.col("o.name").alias("name"), technique.alias("technique_id"), F.col("o.type").alias("kind"), F.when(pattern, "malicious.exploit").otherwise("malicious.malware").alias("subcategory"), F.when(pattern & ~critical, "medium").otherwise("critical").alias("severity"), text.alias("text"))


def policy_labels(text: Column) -> Column:
    """Subcategories of a policy report: two words of a list each; the military one also for a plain word, if there is no other."""
    two = lambda words, sub: F.when(count_hits(text, words) >= 2, F.lit(sub))
    first = F.array_compact(F.array(two(WEAPON_WORDS, "confidential.weapons_systems"), two(NUCLEAR_WORDS, "confidential.nuclear"), two(INTELLIGENCE_WORDS, "confidential.intelligence")))
    military = (count_hits(text, MILITARY_WORDS) >= 2) | ((F.size(first) == 0) & _has(text, MILITARY_FALLBACK))
    return F.concat(first, F.when(military, F.array(F.lit("confidential.military"))).otherwise(F.array().cast("array<string>")))


def injection_rows(rows: DataFrame, templates: list[str], prefix: str, least: int = 10, most: int | None = 5000) -> DataFrame:
    """(id, text, evidence) of rows (text, label) that are injections: one for each start of 100 characters, in a template ("{text}") by hash, `most` by hash (None: all)."""
    text = F.trim("text")
    bad = rows.where((F.trim(F.col("label").cast("string")) == "1") & (F.length(text) >= least)).select(text.alias("t"))
    once = bad.groupBy(F.substring("t", 1, 100).alias("start")).agg(F.min("t").alias("t"))
    at = F.pmod(F.crc32("t"), F.lit(len(templates))).cast("int")
    made = F.element_at(F.array(*[filled(x, text=F.col("t")) for x in templates]), at + 1)
    out = once.select(F.concat(F.lit(prefix), fingerprint(F.col("t"), None)).alias("id"), made.alias("text"), F.substring("t", 1, 200).alias("evidence"))
    return out if most is None else out.orderBy("id").limit(most)


def payload_rows(files: DataFrame) -> DataFrame:
    """(path, folder, subcategory, severity) of payload files whose folder is a known one."""
    folder = F.element_at(F.split("path", "/"), -2)
    subs, grades = _map({k: v[0] for k, v in PAYLOAD_FOLDERS.items()}), _map({k: v[1] for k, v in PAYLOAD_FOLDERS.items()})
    return files.select("path", folder.alias("folder"), F.try_element_at(subs, folder).alias("subcategory"), F.try_element_at(grades, folder).alias("severity")).where("subcategory IS NOT NULL")


def priority_fill(rows: DataFrame, name: str, words: list[str], most: int) -> DataFrame:
    """Rows whose name holds a word of the list come first; then others, up to `most`; each by name."""
    return rows.withColumn("__late", (~_has(F.col(name), words)).cast("int")).orderBy("__late", name).limit(most).drop("__late")


def model_table(rows: DataFrame, models: list[str], value: str = "accuracy") -> DataFrame:
    """(value of the dimension, a column a model) from rows (model, dimension value, accuracy)."""
    return rows.groupBy("key").pivot("model", models).agg(F.first(value))


def benchmark_rows(parts: dict[str, DataFrame], seed: int = 42) -> DataFrame:
    """The union of named selections (text, category, subcategory), numbered in the seeded order, with a file name each."""
    from siftstone.operators.corpus import combine
    from siftstone.operators.ranking import rank_in_group

    rows = combine([df.select("text", "category", "subcategory").withColumn("source", F.lit(name)) for name, df in parts.items()])
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "source", "text"), 256)
    ranked = rank_in_group(rows, [F.lit(0)], order, F.col("text"), "id")
    return ranked.withColumn("file", F.format_string("doc_%05d.txt", F.col("id")))


def generated(spark, n: int, templates: list[str], values: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """(id, text): n texts from templates with {name} places, each part chosen by the hash of seed, id and name."""
    pick = lambda name, choices: F.element_at(F.array(*map(F.lit, choices)), F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.lit(name))), F.lit(len(choices))).cast("int") + 1)
    text = pick("template", templates)
    for name, choices in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), pick(name, choices))
    return spark.range(n).select("id", text.alias("text"))


#: Severity and rules by subcategory of policy reports, and how much of a summary and of a report's own text counts.
POLICY_GRADES = {"confidential.weapons_systems": "critical", "confidential.nuclear": "critical", "confidential.intelligence": "critical", "confidential.military": "high"}
POLICY_RULES = {"confidential.weapons_systems": "ITAR, EO-13526", "confidential.nuclear": "10-CFR-1045, EO-13526", "confidential.intelligence": "EO-13526, NIST-800-53", "confidential.military": "NIST-800-53"}
SUMMARY_CHARS, BODY_CHARS = 4000, 5000


def policy_reports(reports: DataFrame, bodies: DataFrame) -> DataFrame:
    """(report_id, text, findings, from_body) of reports (report_id, title, summary) that a word list speaks for.

    Title and summary decide whether a report stays. One with a body in `bodies` (report_id, text: what its PDF holds, say) is
    then classified once more, by title, summary and the body's first 5,000 characters; the second classification counts, unless
    it finds nothing. Of several bodies the least that isn't empty counts. A report with a null id has none; repeated reports stay,
    each with its own result; null titles and summaries are empty.
    """
    body = bodies.where("text <> ''").groupBy(F.col("report_id").alias("__of")).agg(F.min(F.substring("text", 1, BODY_CHARS)).alias("__body"))
    title, summary = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary"))
    first = reports.select("report_id", title.alias("title"), summary.alias("summary")).withColumn("__first", policy_labels(F.concat_ws(" ", "title", "summary"))).where(F.size("__first") > 0)
    rows = first.join(body, F.col("report_id") == F.col("__of"), "left")
    opening = F.concat(F.lit("CRS Report: "), F.coalesce(F.col("report_id").cast("string"), F.lit("")), F.lit("\nTitle: "), "title", F.when(F.col("summary") != "", F.concat(F.lit("\n\n"), F.substring("summary", 1, SUMMARY_CHARS))).otherwise(""))
    rows = rows.withColumn("text", F.concat(opening, F.when(F.col("__body").isNotNull(), F.concat(F.lit("\n\n"), "__body")).otherwise("")))
    second = F.when(F.col("__body").isNotNull(), policy_labels(F.concat_ws(" ", "title", "text")))
    rows = rows.withColumn("__second", second).withColumn("from_body", F.coalesce(F.size("__second") > 0, F.lit(False)))
    grades, rules = _map(POLICY_GRADES), _map(POLICY_RULES)
    make = lambda s: finding(F.substring_index(s, ".", 1), s, F.substring("title", 1, 200), F.try_element_at(grades, s), F.lit("labelling"), F.create_map(F.lit("compliance"), F.try_element_at(rules, s)))
    return rows.select("report_id", "text", F.transform(F.when(F.col("from_body"), F.col("__second")).otherwise(F.col("__first")), make).cast(FINDINGS).alias("findings"), "from_body")
