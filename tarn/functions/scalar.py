"""Scalar functions as Column expressions. All return null, and never raise, on input they cannot read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import lexicon as L


def let(value: Column, f) -> Column:
    """f(value), with value computed once and not wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(c: Column) -> Column:
    """White space runs to one blank, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def empty_to_null(c: Column) -> Column:
    return F.nullif(collapse(c), F.lit(""))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no query, no fragment, no slashes at the end; empty for null."""
    url = collapse(c)
    whole = F.regexp_replace(url, "[?#].*$", "")
    start = F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    rest = F.substr(whole, F.length(start) + 1)
    return F.concat(F.lower(start), F.regexp_replace(rest, "/+$", ""))


def fingerprint(site: Column, source_id: Column, url: Column, title: Column, company: Column, location: Column) -> Column:
    """SHA-256 of a posting's identity: its id on the board, else its URL, else title, company and place."""
    board, own, link = F.lower(collapse(site)), collapse(source_id), canonical_url(url)
    names = F.concat_ws("|", board, F.lower(collapse(title)), F.lower(collapse(company)), F.lower(collapse(location)))
    return F.sha2(F.when(own != "", F.concat(board, F.lit(":id:"), own)).when(link != "", F.concat(board, F.lit(":url:"), link)).otherwise(names), 256)


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i:02}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def emails(c: Column) -> Column:
    """All addresses in order; null for null or empty."""
    return F.regexp_extract_all(F.nullif(c, F.lit("")), F.lit("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"), 0)


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def first_time(c: Column, *formats: str) -> Column:
    """The first format that reads the text."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def days_ago(c: Column, as_of: Column) -> Column:
    """'N days ago', 'today' and 'just now' as dates before as_of."""
    n = F.nullif(F.regexp_extract(c, "(?i)(\\d+)\\+?\\s*days?\\s+ago", 1), F.lit(""))
    return F.when(c.rlike("(?i)\\btoday\\b|just now|hours?\\b|few hours"), as_of).when(n.isNotNull(), F.date_sub(as_of, n.try_cast("int")))


def currency(c: Column) -> Column:
    """A number with either separator for decimals: '1.234,50' and '1,234.50' are 1234.5."""
    kept = F.regexp_replace(c, "[^-0-9.,]", "")
    n = F.length(kept)
    head = F.regexp_replace(F.substr(kept, F.lit(1), F.greatest(n - 3, F.lit(0))), "[.,]", "")
    tail = F.when(n >= 3, F.substr(kept, n - 2)).otherwise(kept)
    return F.round(F.concat(head, F.when(tail.contains("."), tail).otherwise(F.replace(tail, F.lit(","), F.lit(".")))).try_cast("double"), 2)


def salary_range(c: Column, lower: int = 1000, upper: int = 700_000, hourly: int = 350, monthly: int = 30_000, annual: bool = False) -> Column:
    """struct(interval, min_amount, max_amount, currency) of the first '$a[k] - $b[k]', or null.

    A k at either bound scales both; amounts below `hourly` are hourly, below `monthly` monthly.
    Bounds that would be of different kinds, or annual amounts outside the limits, give null.
    """
    pattern = "\\$(\\d+(?:,\\d+)?(?:\\.\\d+)?)([kK]?)\\s*[-—–]\\s*(?:\\$)?(\\d+(?:,\\d+)?(?:\\.\\d+)?)([kK]?)"
    number = lambda x: F.floor(F.replace(x, F.lit(","), F.lit("")).try_cast("double"))

    def bounds(g: Column) -> Column:
        scale = F.when(F.lower(F.concat(g["b"], g["d"])).contains("k"), 1000).otherwise(1)
        return F.struct((number(g["a"]) * scale).alias("low"), (number(g["c"]) * scale).alias("high"))

    def kind(x: Column) -> Column:
        low = x["low"]
        interval = F.when(low < hourly, "hourly").when(low < monthly, "monthly").otherwise("yearly")
        limit, times = F.when(low < hourly, hourly).when(low < monthly, monthly), F.when(low < hourly, 2080).when(low < monthly, 12).otherwise(1)
        return F.struct(interval.alias("interval"), low.alias("low"), x["high"].alias("high"), (low * times).alias("a"), F.when(limit.isNull() | (x["high"] < limit), x["high"] * times).alias("b"))

    def judged(x: Column) -> Column:
        ok = x["a"].between(lower, upper) & x["b"].between(lower, upper) & (x["a"] < x["b"])
        low, high = ("a", "b") if annual else ("low", "high")
        return F.when(ok, F.struct(x["interval"].alias("interval"), x[low].alias("min_amount"), x[high].alias("max_amount"), F.lit("USD").alias("currency")))

    groups = F.struct(*[F.regexp_extract(c, pattern, i).alias(n) for i, n in enumerate("abcd", 1)])
    return let(let(let(groups, bounds), kind), judged)


def annual(amount: Column, interval: Column) -> Column:
    """An amount for a year; unknown intervals are taken as yearly."""
    factor = reduce(lambda acc, x: acc.when(interval == x[0], x[1]), list(L.PER_YEAR.items())[1:], F.when(interval == "hourly", L.PER_YEAR["hourly"])).otherwise(1)
    return amount * factor


def lakh_salary(c: Column) -> Column:
    """struct(min_amount, max_amount, currency) of '3-6 Lacs P.A' or '1-2 Cr'."""
    pattern = "(?i)(\\d+(?:\\.\\d+)?)\\s*-\\s*(\\d+(?:\\.\\d+)?)\\s*(Lacs|Lakh|Cr)"
    unit = F.lower(F.regexp_extract(c, pattern, 3))
    times = F.when(unit == "cr", 10_000_000).otherwise(100_000)
    amount = lambda i: (F.regexp_extract(c, pattern, i).try_cast("double") * times).cast("long")
    return F.when(unit != "", F.struct(amount(1).alias("min_amount"), amount(2).alias("max_amount"), F.lit("INR").alias("currency")))


def is_remote(*texts: Column) -> Column:
    return F.concat_ws(" ", *texts).rlike(L.REMOTE)


def work_place(*texts: Column) -> Column:
    """Hybrid before remote before office."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.when(text.contains("hybrid"), "Hybrid").when(text.contains("remote") | text.contains("work from home"), "Remote").when(text.contains("work from office"), "Work from office")


def location_parts(c: Column) -> Column:
    """struct(city, state, country) of 'City, State, Country' or 'City, State'; 'Remote' has none."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    n = F.size(parts)
    field = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.when(c.isNotNull() & ~F.lower(F.trim(c)).isin("remote", ""), F.struct(field(0).alias("city"), F.when(n >= 2, field(1)).alias("state"), F.when(n >= 3, field(2)).alias("country")))


def location_display(city: Column, state: Column, country: Column) -> Column:
    """'City, State, Country': usa and uk in capitals, worldwide and us-canada not shown."""
    low = F.lower(country)
    shown = F.when(low.isin("usa", "uk"), F.upper(country)).when(~low.isin("worldwide", "us/canada"), F.initcap(country))
    return F.concat_ws(", ", city, state, shown)


def _named(c: Column, names: tuple[tuple[str, ...], ...]) -> Column:
    """The first of the names among which c is, or null."""
    pairs = [F.lit(x) for own in names for name in own for x in (name, own[0])]
    return F.try_element_at(F.create_map(*pairs), c)


def country(c: Column) -> Column:
    """The name shown of a country, by any of its names; null for others."""
    return _named(F.lower(collapse(c)), L.COUNTRIES)


def job_type(c: Column) -> Column:
    """The name shown of a job type as a board writes it, in any of its languages; null for others."""
    return _named(F.regexp_replace(F.lower(collapse(c)), "[ _-]", ""), L.JOB_TYPES)


def job_types(c: Column) -> Column:
    """Names of the job types that a description mentions."""
    return F.filter(F.array(*[F.when(c.rlike(p), name) for name, p in L.JOB_TYPE_WORDS]), lambda x: x.isNotNull())


def salary_display(low: Column, high: Column, money: Column, interval: Column) -> Column:
    text = lambda x: F.coalesce(F.format_number(x, 0), F.lit("?"))
    return F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(" ", money, F.concat(text(low), F.lit("–"), text(high)), interval))


def heading_section(line: Column, patterns: tuple = L.SECTION_PATTERNS) -> Column:
    """The section that a line opens, or null: a sentence, an empty and an over-long line open none."""
    compact = F.trim(F.regexp_replace(line, "(?U)[^\\w\\s'’]", ""))
    found = F.coalesce(*[F.when(compact.rlike(f"(?iU){p}"), F.lit(name)) for name, p in patterns])
    return F.when(~F.trim(line).rlike("[.!?。！？]$") & (compact != "") & (F.length(compact) <= 90), found)


def is_list_item(line: Column) -> Column:
    return line.rlike("^(?:[-*•]|\\d+[.)])\\s+")


def contains_term(text: Column, term: str) -> Column:
    """Latin terms as whole words, others as substrings, whatever the case."""
    import re

    low = term.casefold()
    if re.fullmatch(r"[a-z0-9+#.-]+", low):
        return F.lower(text).rlike(f"(?<![a-z0-9]){re.escape(low)}(?![a-z0-9])")
    return F.lower(text).contains(low)


def term_count(text: Column, term: str) -> Column:
    """Occurrences that do not overlap, whatever the case."""
    low = term.casefold()
    t = F.lower(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(low), F.lit("")))) / len(low)).cast("long")


def title_family(title: Column, company: Column) -> Column:
    """One key for reposts of a title: without '(PhD)', a start year and punctuation, after the company."""
    t = F.lower(title)
    for pattern in ("\\(\\s*ph\\.?d\\.?\\s*\\)", "[-–—]\\s*20\\d{2}\\s*start.*$", "\\b20\\d{2}\\s*start\\b", "(?U)[\\W_]+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.concat(F.lower(F.coalesce(company, F.lit(""))), F.lit("|"), F.trim(F.regexp_replace(t, " +", " ")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def overlap(text: Column, terms: list[str]) -> Column:
    """The part of the terms that a text contains."""
    if not terms:
        return F.lit(0.0)
    return reduce(lambda x, y: x + y, [F.lower(text).contains(t).cast("int") for t in terms]) / float(len(terms))


def route(question: Column) -> Column:
    return F.coalesce(*[F.when(question.rlike(p), F.lit(name)) for name, p in L.ROUTES], F.lit("evidence"))


def has_amount(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [text.rlike(p) for p in L.PAY_AMOUNTS])


def citations(answer: Column) -> Column:
    """Distinct cited numbers, sorted; one that no int holds is the largest int."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"), 1), lambda x: F.coalesce(x.try_cast("int"), F.lit(2147483647)))))


def citation_check(answer: Column, sources: Column) -> Column:
    """struct(valid, invalid, status): passed if some number is valid and none is not."""
    cited = citations(answer)
    valid, invalid = F.filter(cited, lambda n: (n >= 1) & (n <= sources)), F.filter(cited, lambda n: (n < 1) | (n > sources))
    return F.struct(valid.alias("valid"), invalid.alias("invalid"), F.when((F.size(valid) > 0) & (F.size(invalid) == 0), "passed").otherwise("failed").alias("status"))


def fenced_json(c: Column) -> Column:
    """The JSON object in an answer, with or without a code fence; null if there is none."""
    inner = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    return F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner)


def bounded(c: Column, low: int = 1, high: int = 5) -> Column:
    n = c.try_cast("int")  # least and greatest pass over nulls
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(low)), F.lit(high)))


def citation_coverage(answer: Column, claims: Column) -> Column:
    """Distinct cited numbers for each claim, 1 at most; 1 without claims."""
    return F.when(claims <= 0, 1.0).otherwise(F.least(F.try_divide(F.size(citations(answer)).cast("double"), claims), F.lit(1.0)))


def quote_words(c: Column) -> Column:
    """Text as quotes are compared: in lower case, with single blanks."""
    return F.when(c.isNotNull(), F.lower(collapse(c)))


def quote_found(quote: Column, evidence: Column) -> Column:
    """Whether the evidence, as quote_words gives it, contains the quote, whatever the case and the blanks; an empty quote is not found, and of a null one, or in null, nothing is known."""
    words = quote_words(quote)
    return (words != "") & evidence.contains(words)


def numeric_id(source_id: Column, url: Column) -> Column:
    """The number that ends a board's own id, else the one of its page's address; null if there is none."""
    own = F.regexp_extract(F.coalesce(source_id, F.lit("")), "(\\d+)$", 1)
    page = F.regexp_extract(F.coalesce(url, F.lit("")), "/jobs/view/(?:[^/?#]*-)?(\\d+)", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(page, F.lit("")))


def iso_text(c: Column) -> Column:
    """A time as ISO text, with a fraction where it has one."""
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""))
