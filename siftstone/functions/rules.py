"""The rule net: ordered patterns compiled into one expression per subcategory.

A subcategory takes its first matching rule. Patterns run with Unicode classes. Rules with a literal that every match
must hold test it first: a plain search is far cheaper than a pattern, and it keeps backtracking away from hostile
texts that lack it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.text import once
from siftstone.schema import FINDINGS, finding


class Rule(NamedTuple):
    name: str
    subcategory: str
    severity: str
    pattern: str
    needs: str = ""  # a literal that stands in every match
    gate: str = ""  # a cheap pattern that finds something in every match; rules share it

    @property
    def label(self) -> str:
        return self.name.replace("_", " ")


# What stands in every match of several rules: nine digits, seven in a row, four after a word for number, hidden ones, part of a date, an end of a word for secret.
NINE, SEVEN, NUMBERED, MASKED, DAY, SET = r"\d(?:[\s-]?\d){8}", r"\d{7}", r"[rRmMoO#]\s*:?\s*\d{4}", r"[*xX]{2}[-\d]", r"[/\-]\d", r"[rRwWeE][dDtTnN]\s*[:=]"
# The rule catalogue in order of precedence.
RULES = [
    Rule("template_class_access", "malicious.injection", "critical", r"\{\{[^}]*__class__", "__class__"),
    Rule("template_mro_access", "malicious.injection", "critical", r"\{\{[^}]*__mro__", "__mro__"),
    Rule("template_subclasses_access", "malicious.injection", "critical", r"\{\{[^}]*__subclasses__", "__subclasses__"),
    Rule("template_config_access", "malicious.injection", "high", r"\{\{[^}]*config\s*\.", "config"),
    Rule("template_request_access", "malicious.injection", "high", r"\{\{[^}]*request\s*\.", "request"),
    Rule("expression_runtime_class", "malicious.injection", "critical", r"\$\{[^}]*Runtime\s*\.", "Runtime"),
    Rule("expression_get_runtime", "malicious.injection", "critical", r"\$\{[^}]*getRuntime", "getRuntime"),
    Rule("velocity_class_access", "malicious.injection", "critical", r"#set\s*\(\s*\$[^)]*class\s*\.", "#set"),
    Rule("doctype_with_entity", "malicious.injection", "critical", r"(?s)<!DOCTYPE[^>]*\[.*<!ENTITY", "<!ENTITY"),
    Rule("system_entity", "malicious.injection", "critical", r"""<!ENTITY[^>]*SYSTEM\s*["']""", "<!ENTITY"),
    Rule("public_entity", "malicious.injection", "high", r"""<!ENTITY[^>]*PUBLIC\s*["']""", "<!ENTITY"),
    Rule("pickle_loads", "malicious.exploit", "critical", r"pickle\.loads\s*\(", "pickle.loads"),
    Rule("java_object_stream", "malicious.exploit", "high", r"ObjectInputStream", "ObjectInputStream"),
    Rule("php_unserialize", "malicious.exploit", "critical", r"unserialize\s*\(", "unserialize"),
    Rule("ruby_marshal_load", "malicious.exploit", "critical", r"Marshal\.load\s*\(", "Marshal.load"),
    Rule("dotnet_binary_formatter", "malicious.exploit", "critical", r"BinaryFormatter\.Deserialize", "BinaryFormatter.Deserialize"),
    Rule("eval_of_atob", "malicious.shell", "critical", r"\beval\s*\(\s*atob\b", "atob"),
    Rule("exec_of_compile", "malicious.shell", "critical", r"\bexec\s*\(\s*compile\b", "compile"),
    Rule("import_of_os", "malicious.shell", "critical", r"""\b__import__\s*\(\s*['"]os['"]\s*\)""", "__import__"),
    Rule("netcat_shell", "malicious.shell", "critical", r"\b(nc|ncat|netcat)\s+.*-e\s+/bin/(sh|bash)", "/bin/"),
    Rule("dev_tcp_shell", "malicious.shell", "critical", r"/dev/tcp/", "/dev/tcp/"),
    Rule("aws_metadata_address", "malicious.ssrf", "high", r"169\.254\.169\.254", "169.254.169.254"),
    Rule("gcp_metadata_host", "malicious.ssrf", "high", r"metadata\.google\.internal", "metadata.google.internal"),
    Rule("alibaba_metadata_address", "malicious.ssrf", "high", r"100\.100\.100\.200", "100.100.100.200"),
    Rule("npm_hook_runs_curl", "malicious.exploit", "critical", r'"(preinstall|postinstall|preuninstall)":\s*"[^"]*curl\s', "install"),
    Rule("npm_hook_runs_wget", "malicious.exploit", "critical", r'"(preinstall|postinstall)":\s*"[^"]*wget\s', "install"),
    Rule("setup_py_runs_system", "malicious.exploit", "critical", r"(?s)cmdclass.*install.*os\.system", "os.system"),
    Rule("ignore_instructions", "malicious.prompt_injection", "high", r"(?i)ignore\s+(all\s+)?previous\s+instructions"),
    Rule("unrestricted_role", "malicious.prompt_injection", "high", r"(?i)you\s+are\s+now\s+(DAN|an?\s+unrestricted)"),
    Rule("system_override", "malicious.prompt_injection", "high", r"(?i)system:\s*override", ":"),
    Rule("social_security_number", "pii.identity", "critical", r"\b\d{3}-\d{2}-\d{4}\b", "-", gate=NINE),
    Rule("masked_social_security_number", "pii.identity", "high", r"(?i)(\*{3}-\*{2}-\d{4}|XXX-XX-\d{4}|xxx-xx-\d{4}|\*{5,}\d{4})", gate=MASKED),
    Rule("date_of_birth", "pii.identity", "high", r"(?i)\b(DOB|date\s+of\s+birth|birth\s*date)\s*[:=]\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", gate=DAY),
    Rule("visa_number", "financial.credit_card", "critical", r"\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", gate=NINE),
    Rule("mastercard_number", "financial.credit_card", "critical", r"\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", gate=NINE),
    Rule("amex_number", "financial.credit_card", "critical", r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b", gate=NINE),
    Rule("masked_account_number", "financial.bank_account", "high", r"\*{4,}\d{4}", "****"),
    Rule("iban", "financial.bank_account", "critical", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?\d{0,16})\b", gate=SEVEN),
    Rule("aws_access_key", "credentials.api_key", "critical", r"\bAKIA[A-Z0-9]{16}\b", "AKIA"),
    Rule("payment_api_key", "credentials.api_key", "critical", r"\b(sk|pk)_(live|test)_[a-zA-Z0-9]{20,}", "k_"),
    Rule("git_host_token", "credentials.token", "critical", r"\b(ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36,}\b", "gh", gate="gh[pousr]_"),
    Rule("private_key_block", "credentials.private_key", "critical", r"-----BEGIN\s+(RSA|EC|DSA|OPENSSH|PGP)\s+PRIVATE\s+KEY-----", "-----BEGIN"),
    Rule("secret_in_text", "credentials.password", "high", r"""(?i)(password|passwd|pwd|secret|token)\s*[:=]\s*["']?[^\s"']{8,}""", gate=SET),
    Rule("connection_string", "credentials.connection_string", "critical", r"(?i)(mongodb|postgres|mysql|redis|amqp)://[^\s]+@[^\s]+", "://"),
    Rule("employer_number", "pii.identity", "high", r"\b\d{2}-\d{7}\b", "-", gate=NINE),
    Rule("routing_number", "financial.bank_account", "high", r"(?i)(routing|aba|transit)\s*#?\s*:?\s*\d{9}\b", gate=NINE),
    Rule("loan_or_account_number", "financial.bank_account", "high", r"(?i)(loan|account|acct|policy)\s*(number|num|no|#)\s*:?\s*\d{6,15}", gate=NUMBERED),
    Rule("check_number", "financial.transaction", "medium", r"(?i)check\s*(number|num|no|#)\s*:?\s*\d{4,10}", gate=NUMBERED),
]
YAML_LOAD = r"yaml\.load\s*\([^)]*\)"
YAML_SAFE = r"Loader\s*=\s*SafeLoader"
# Shown matches, longest shown match and what is kept of longer ones, characters looked at after yaml.load.
SHOWN, LONGEST, KEPT, VICINITY = 5, 40, 37, 100


def unicode(pattern: str) -> str:
    return f"(?U){pattern}"


def matches(text: Column, rule: Rule) -> Column:
    hit = text.rlike(unicode(rule.pattern))
    return F.coalesce(text.contains(rule.needs) & hit if rule.needs else hit, F.lit(False))


def match_list(text: Column, pattern: str) -> Column:
    """Distinct matches in order of their characters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(unicode(pattern)), F.lit(0))))


def shortened(x: Column) -> Column:
    return F.when(F.length(x) > LONGEST, F.concat(F.substring(x, 1, KEPT), F.lit("..."))).otherwise(x)


def rule_numbers(text: Column, rules: list[Rule] = RULES) -> Column:
    """array<int>: for each subcategory with a match the number of its first matching rule, in rule order."""
    by_sub: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        by_sub.setdefault(rule.subcategory, []).append(n)
    gates = list({rule.gate: None for rule in rules if rule.gate})
    found = F.array(*[F.coalesce(text.rlike(unicode(g)), F.lit(False)) for g in gates])

    def hit(n: int, open_gates: Column) -> Column:
        of = matches(text, rules[n])
        return open_gates[gates.index(rules[n].gate)] & of if rules[n].gate else of

    def first(open_gates: Column) -> Column:
        return F.array(*[F.coalesce(*[F.when(hit(n, open_gates), F.lit(n)) for n in numbers]) for numbers in by_sub.values()])

    return F.array_sort(F.array_compact(once(found, first)))


def rule_finding(text: Column, number: Column, rules: list[Rule] = RULES) -> Column:
    """The finding of the rule of a number: its matches are made once, then read for words and extracted data."""
    of = lambda values: F.get(F.array(*map(F.lit, values)), number)
    sub = of([r.subcategory for r in rules])

    def made(found: Column) -> Column:
        shown = F.transform(F.slice(found, 1, SHOWN), shortened)
        more = F.when(F.size(found) > SHOWN, F.concat(F.lit(" (+"), (F.size(found) - SHOWN).cast("string"), F.lit(" more)"))).otherwise("")
        extracted = F.map_from_entries(F.transform(shown, lambda x, i: F.struct(F.concat(F.lit("match_"), (i + 1).cast("string")).alias("key"), x.alias("value"))))
        return finding(F.substring_index(sub, ".", 1), sub, F.concat(of([r.label for r in rules]), F.lit(": "), F.array_join(shown, ", "), more), of([r.severity for r in rules]), F.lit("regex"), extracted)

    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, of([unicode(r.pattern) for r in rules]), F.lit(0))))
    return F.get(F.transform(F.array(found), made), F.lit(0))


def unsafe_yaml(text: Column, every: bool = False) -> Column:
    """Whether yaml.load is called without SafeLoader in the call or the characters after it: the first call, or any."""
    calls = F.regexp_extract_all(text, F.lit(unicode(YAML_LOAD)), F.lit(0))
    if every:
        bare = F.exists(F.regexp_extract_all(text, F.lit(f"(?sU){YAML_LOAD}.{{0,{VICINITY}}}"), F.lit(0)), lambda x: ~x.rlike(unicode(YAML_SAFE)))
        return F.coalesce(text.contains("yaml.load") & bare, F.lit(False))
    at = F.regexp_instr(text, F.lit(unicode(YAML_LOAD)))
    near = F.substring(text, at, F.length(F.get(calls, F.lit(0))) + VICINITY)
    return F.coalesce(text.contains("yaml.load") & (at > 0) & ~near.rlike(unicode(YAML_SAFE)), F.lit(False))


def safety_net(text: Column, found: Column | None = None, rules: list[Rule] = RULES, numbers: Column | None = None) -> Column:
    """Findings of the rule net over a text.

    found: findings that a model has made; rules of a category among them are skipped. Order is rule order, then the
    yaml check, which only speaks where no other exploit rule has. numbers: a column made by `rule_numbers`, so that a
    plan tests the patterns once, in a projection of its own, and extracts only where one has matched.
    """
    hit = rule_numbers(text, rules) if numbers is None else numbers
    have = lambda category: F.lit(False) if found is None else F.coalesce(F.exists(found, lambda f: f["category"] == category), F.lit(False))
    categories = F.array(*[F.lit(r.subcategory.split(".")[0]) for r in rules])
    speaking = hit if found is None else F.filter(hit, lambda n: ~F.coalesce(F.exists(found, lambda f: f["category"] == F.get(categories, n)), F.lit(False)))
    net = F.transform(speaking, lambda n: rule_finding(text, n, rules))
    call = F.substring(F.get(F.regexp_extract_all(text, F.lit(unicode(YAML_LOAD)), F.lit(0)), F.lit(0)), 1, 200)
    yaml = F.array(finding(F.lit("malicious"), F.lit("malicious.exploit"), F.lit("yaml load without safe loader"), F.lit("critical"), F.lit("regex"), evidence=call)).cast(FINDINGS)
    exploits = F.arrays_overlap(hit, F.array(*[F.lit(n) for n, r in enumerate(rules) if r.subcategory == "malicious.exploit"]))
    none = F.array().cast(FINDINGS)
    rest = F.when(~have("malicious") & unsafe_yaml(text) & ~exploits, yaml).otherwise(none)
    return F.concat(F.when(F.size(hit) > 0, net.cast(FINDINGS)).otherwise(none), rest)


# Order in which the baseline classifier prefers categories, and the characters it reads.
PRIORITY = ["malicious", "credentials", "pii", "financial", "medical", "confidential"]
BASELINE_CHARS = 6000


def baseline_label(text: Column, rules: list[Rule] = RULES) -> Column:
    """struct<category, subcategory> of the likeliest category by priority; safe without a match."""
    head = F.substring(text, 1, BASELINE_CHARS)
    by_category: dict[str, list[Column]] = {}
    for rule in rules:
        by_category.setdefault(rule.subcategory.split(".")[0], []).append(F.when(matches(head, rule), F.lit(rule.subcategory)))
    by_category["malicious"].append(F.when(unsafe_yaml(head, every=True), F.lit("malicious.exploit")))
    sub = F.coalesce(*[x for c in PRIORITY for x in by_category.get(c, [])], F.lit("safe.documentation"))
    return F.struct(F.split(sub, "\\.")[0].alias("category"), sub.alias("subcategory"))
