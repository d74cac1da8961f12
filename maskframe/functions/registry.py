"""Categories of personal data, as metadata of projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and word characters as the detectors mean them, as the inside of a Java character class.
SPACE = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
REDACTED = "[REDACTED]"
MODES = ("redacted", "label", "pseudonym")
GROUPS = ("contact", "financial", "identifier", "location", "other")


@dataclass(frozen=True)
class Category:
    """One category. ``priority``: of spans that start together the lower wins; ``key`` names the pseudonym key."""

    name: str
    priority: int
    label: str
    prefix: str
    enabled: bool
    group: str
    literal: str
    key: str
    singular: str
    plural: str
    user_authored: bool = False


# Fixed values, in the order of display and detection.
CATEGORIES: tuple[Category, ...] = (
    Category("manual", -10, "REDACTED", "REDACTED", True, "other", "literal", "text", "Marked by you", "Marked by you", True),
    Category("email", 1, "EMAIL", "EMAIL", True, "contact", "literal", "lower", "Email address", "Email addresses"),
    Category("url", 2, "URL", "URL", False, "contact", "literal", "url", "Web address", "Web addresses"),
    Category("secret", 0, "SECRET", "SECRET", True, "identifier", "literal", "trim", "API key or credential", "API keys and credentials"),
    Category("iban", 3, "IBAN", "IBAN", True, "financial", "literal", "alnum", "Bank account (IBAN)", "Bank accounts (IBAN)"),
    Category("ssn", 5, "SSN", "SSN", True, "identifier", "digits", "digits", "Social Security Number", "Social Security Numbers"),
    Category("creditCard", 4, "CARD", "CARD", True, "financial", "digits", "digits", "Credit card number", "Credit card numbers"),
    Category("date", 10, "DATE", "DATE", True, "other", "literal", "text", "Date", "Dates"),
    Category("phone", 13, "PHONE", "PHONE", True, "contact", "digits", "digits", "Phone number", "Phone numbers"),
    Category("nationalId", 7, "ID", "ID", True, "identifier", "digits", "digits", "National ID number", "National ID numbers"),
    Category("routingNumber", 6, "ROUTING", "ROUTING", True, "financial", "digits", "digits", "Bank routing number", "Bank routing numbers"),
    Category("macAddress", 8, "MAC", "MAC", True, "identifier", "literal", "alnum", "MAC address", "MAC addresses"),
    Category("ipAddress", 9, "IP", "IP", True, "identifier", "literal", "lower", "IP address", "IP addresses"),
    Category("passport", 11, "PASSPORT", "PASSPORT", True, "identifier", "literal", "upper", "Passport number", "Passport numbers"),
    Category("driversLicence", 12, "LICENCE", "LICENCE", True, "identifier", "literal", "upper", "Driving licence number", "Driving licence numbers"),
    Category("postalCode", 15, "POSTCODE", "POSTCODE", False, "location", "literal", "postcode", "Postal code", "Postal codes"),
    Category("accountNumber", 14, "NUMBER", "NUMBER", True, "financial", "digits", "digits", "Long number (account, reference)", "Long numbers (account, reference)"),
    Category("age", 16, "AGE", "AGE", True, "other", "digits", "digits", "Age", "Ages"),
    Category("person", 17, "NAME", "PERSON", True, "other", "literal", "text", "Name", "Names"),
    Category("place", 18, "ADDRESS", "PLACE", True, "location", "literal", "text", "Address", "Addresses"),
)

_BY_NAME = {c.name: c for c in CATEGORIES}


def all_categories() -> tuple[str, ...]:
    return tuple(_BY_NAME)


def category(name: str) -> Category:
    return _BY_NAME[name]


def is_category(name: str) -> bool:
    return name in _BY_NAME


def configurable_categories() -> tuple[str, ...]:
    return tuple(c.name for c in _BY_NAME.values() if not c.user_authored)


def categories_in_group(group: str) -> tuple[str, ...]:
    return tuple(c.name for c in _BY_NAME.values() if c.group == group and not c.user_authored)


def category_label(name: str, count: int = 1) -> str:
    c = _BY_NAME[name]
    return c.singular if count == 1 else c.plural


def register(c: Category) -> None:
    """Add a category; its priority must be its own. Its detector is registered with the detectors."""
    if any(o.priority == c.priority and o.name != c.name for o in _BY_NAME.values()):
        raise ValueError(f"priority {c.priority} is taken")
    _BY_NAME[c.name] = c


@dataclass(frozen=True)
class Options:
    """What to look for: categories that are on, and exact values that replace a category's detection."""

    enabled: frozenset[str] = field(default_factory=lambda: frozenset(c.name for c in _BY_NAME.values() if c.enabled))
    exact: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def only(*names: str, **exact: str) -> Options:
        return Options(frozenset(names) | frozenset(exact), exact)

    def with_group(self, group: str, on: bool) -> Options:
        names = frozenset(categories_in_group(group))
        return Options(self.enabled | names if on else self.enabled - names, self.exact)

    def exact_values(self, name: str) -> list[str]:
        """Values of a category's comma-separated list; a list without values counts as not given."""
        return [v.strip() for v in self.exact.get(name, "").split(",") if v.strip()]

    @property
    def any_enabled(self) -> bool:
        return any(n in self.enabled for n in configurable_categories())


def lookup(column: Column, attribute: str) -> Column:
    """A category column's attribute as a constant map lookup."""
    pairs = [F.lit(x) for c in _BY_NAME.values() for x in (c.name, getattr(c, attribute))]
    return F.element_at(F.create_map(*pairs), column)


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(i, c.name, c.priority, c.label, c.prefix, c.enabled, c.group, c.literal, c.singular, c.plural) for i, c in enumerate(_BY_NAME.values(), 1)]
    return spark.createDataFrame(rows, "position int, category string, priority int, label string, prefix string, enabled boolean, grp string, literal_mode string, singular string, plural string")


def pseudonym_key(name: Column, text: Column) -> Column:
    """What makes two values of a category the same value."""
    spaces = f"[{SPACE}]+"
    trimmed = F.regexp_replace(text, f"^{spaces}|{spaces}$", "")
    how = {
        "text": F.regexp_replace(F.lower(trimmed), spaces, " "),
        "lower": F.lower(trimmed),
        "url": F.regexp_replace(F.lower(trimmed), "/+$", ""),
        "trim": trimmed,
        "alnum": F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")),
        "digits": F.regexp_replace(text, "[^0-9]", ""),
        "upper": F.upper(trimmed),
        "postcode": F.regexp_replace(F.upper(trimmed), spaces, ""),
    }
    out = how["text"]
    for kind, value in how.items():
        names = [c.name for c in _BY_NAME.values() if c.key == kind]
        if names and kind != "text":
            out = F.when(name.isin(*names), value).otherwise(out)
    return out
