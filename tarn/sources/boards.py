"""Landed board records to one flat frame.

Collection itself is out of scope (no network); raw API answers and pages land as files. Each
board has a reader of its raw rows; collect() unites them with all columns in one order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import lexicon as L
from tarn.functions import scalar as S
from tarn.operators.filters import both
from tarn.sources import html

# Columns of the flat frame, in order.
FLAT = (
    "id", "site", "job_url", "job_url_direct", "title", "company", "location", "date_posted", "job_type", "salary_source", "interval",
    "min_amount", "max_amount", "currency", "is_remote", "job_level", "job_function", "listing_type", "emails", "description",
    "company_industry", "company_url", "company_logo", "company_url_direct", "company_addresses", "company_num_employees", "company_revenue",
    "company_description", "skills", "experience_range", "company_rating", "company_reviews_count", "vacancy_count", "work_from_home_type",
)


def _json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("payload", schema).alias("j"))


def indeed(df: DataFrame) -> DataFrame:
    """payload: {"results": [{"job": {...}}]}."""
    pay = "struct<unitOfWork:string,range:struct<min:double,max:double>>"
    money = f"struct<baseSalary:{pay},estimated:struct<currencyCode:string,baseSalary:{pay}>,currencyCode:string>"
    job = f"struct<key:string,title:string,datePublished:bigint,description:struct<html:string>,employer:struct<name:string>,location:struct<city:string,admin1Code:string,countryCode:string>,compensation:{money}>"
    rows = _json(df, f"results array<struct<job:{job}>>").select(F.explode("j.results").alias("r")).select("r.job.*")
    base = F.coalesce("compensation.baseSalary", "compensation.estimated.baseSalary")
    unit = F.lower(base["unitOfWork"])
    interval = F.when(unit == "hour", "hourly").when(unit == "day", "daily").when(unit == "week", "weekly").when(unit == "month", "monthly").when(unit == "year", "yearly")
    return rows.select(
        F.concat(F.lit("in-"), "key").alias("id"), F.lit("indeed").alias("site"), F.concat(F.lit("https://www.indeed.com/viewjob?jk="), "key").alias("job_url"), "title",
        F.col("employer.name").alias("company"), S.location_display(F.col("location.city"), F.col("location.admin1Code"), F.col("location.countryCode")).alias("location"),
        F.to_date(F.timestamp_millis("datePublished")).alias("date_posted"), html.plain(F.col("description.html")).alias("description"),
        interval.alias("interval"), F.floor(base["range"]["min"]).cast("double").alias("min_amount"), F.floor(base["range"]["max"]).cast("double").alias("max_amount"),
        F.coalesce("compensation.currencyCode", "compensation.estimated.currencyCode").alias("currency"),
        S.is_remote(F.col("title"), F.col("description.html")).alias("is_remote"),
    )


def naukri(df: DataFrame, as_of: Column) -> DataFrame:
    """payload: {"jobDetails": [{...}]}."""
    one = "struct<jobId:string,title:string,companyName:string,jdURL:string,jobDescription:string,footerPlaceholderLabel:string,tagsAndSkills:string,placeholders:array<struct<type:string,label:string>>>"
    rows = _json(df, f"jobDetails array<{one}>").select(F.explode("j.jobDetails").alias("r")).select("r.*")
    label = lambda t: F.get(F.transform(F.filter("placeholders", lambda p: p["type"] == t), lambda p: p["label"]), F.lit(0))
    pay = S.lakh_salary(label("salary"))
    return rows.select(
        F.concat(F.lit("nk-"), "jobId").alias("id"), F.lit("naukri").alias("site"), F.concat(F.lit("https://www.naukri.com"), "jdURL").alias("job_url"), "title", F.col("companyName").alias("company"),
        label("location").alias("location"), S.days_ago(F.col("footerPlaceholderLabel"), as_of).alias("date_posted"), html.plain(F.col("jobDescription")).alias("description"),
        pay["min_amount"].cast("double").alias("min_amount"), pay["max_amount"].cast("double").alias("max_amount"), pay["currency"].alias("currency"), F.when(pay.isNotNull(), "yearly").alias("interval"),
        label("experience").alias("experience_range"), F.array_join(F.split("tagsAndSkills", ","), ", ").alias("skills"), S.work_place(F.col("title"), F.col("jobDescription"), label("location")).alias("work_from_home_type"),
        S.is_remote(F.col("title"), F.col("jobDescription"), label("location")).alias("is_remote"),
    )


def ziprecruiter(df: DataFrame) -> DataFrame:
    """payload: {"jobs": [{...}]}."""
    one = "struct<listing_key:string,name:string,hiring_company:struct<name:string>,job_city:string,job_state:string,job_country:string,posted_time:string,job_description:string,employment_type:string,compensation_interval:string,compensation_min:double,compensation_max:double,compensation_currency:string>"
    rows = _json(df, f"jobs array<{one}>").select(F.explode("j.jobs").alias("r")).select("r.*")
    interval = F.when(F.col("compensation_interval") == "annual", "yearly").otherwise(F.col("compensation_interval"))
    return rows.select(
        F.concat(F.lit("zr-"), "listing_key").alias("id"), F.lit("zip_recruiter").alias("site"), F.concat(F.lit("https://www.ziprecruiter.com/jobs//j?lvk="), "listing_key").alias("job_url"), F.col("name").alias("title"),
        F.col("hiring_company.name").alias("company"), S.location_display(F.col("job_city"), F.col("job_state"), F.when(F.col("job_country") == "US", "usa").otherwise(F.lit("canada"))).alias("location"),
        S.iso_date(F.col("posted_time")).alias("date_posted"), html.plain(F.col("job_description")).alias("description"), F.replace(F.lower("employment_type"), F.lit("_"), F.lit("")).alias("job_type"),
        interval.alias("interval"), F.floor("compensation_min").cast("double").alias("min_amount"), F.floor("compensation_max").cast("double").alias("max_amount"), F.col("compensation_currency").alias("currency"),
    )


def glassdoor(df: DataFrame, as_of: Column) -> DataFrame:
    """payload: {"jobListings": [{"jobview": {"header": {...}, "job": {...}}}]}; a missing age gives no date."""
    head = "struct<jobTitleText:string,employerNameFromSearch:string,locationName:string,locationType:string,ageInDays:int,payPeriod:string,payCurrency:string,payPeriodAdjustedPay:struct<p10:double,p90:double>>"
    rows = _json(df, f"jobListings array<struct<jobview:struct<header:{head},job:struct<listingId:bigint,description:string>>>>").select(F.explode("j.jobListings").alias("r")).select("r.jobview.*")
    period = F.col("header.payPeriod")
    interval = F.when(period == "ANNUAL", "yearly").when(period == "MONTHLY", "monthly").when(period == "WEEKLY", "weekly").when(period == "DAILY", "daily").when(period == "HOURLY", "hourly")
    place = S.location_parts(F.col("header.locationName"))
    return rows.select(
        F.concat(F.lit("gd-"), F.col("job.listingId").cast("string")).alias("id"), F.lit("glassdoor").alias("site"), F.concat(F.lit("https://www.glassdoor.com/job-listing/j?jl="), F.col("job.listingId").cast("string")).alias("job_url"),
        F.col("header.jobTitleText").alias("title"), F.col("header.employerNameFromSearch").alias("company"), F.concat_ws(", ", place["city"], place["state"]).alias("location"),
        F.date_sub(as_of, F.col("header.ageInDays")).alias("date_posted"), html.plain(F.col("job.description")).alias("description"), interval.alias("interval"),
        F.floor("header.payPeriodAdjustedPay.p10").cast("double").alias("min_amount"), F.floor("header.payPeriodAdjustedPay.p90").cast("double").alias("max_amount"), F.col("header.payCurrency").alias("currency"),
        (F.col("header.locationType") == "S").alias("is_remote"),
    )


def cards(df: DataFrame, site: str, starts: tuple[str, ...], fields: dict[str, str], link: str, base: str, own_id: str) -> DataFrame:
    """Pages of HTML cards.

    The first of the patterns in starts that a page has tells where its cards begin; a card goes to where the
    next begins, so a field that one lacks is never taken from another. Each field is the first group of its
    pattern in the card. A link without a host gets base; own_id finds the board's id in it, else the id is a
    digest of the link. A card without link is none; of cards of one id the first on the page stays.
    """
    def cut(start: str) -> Column:
        return F.when(F.col("payload").rlike(start), F.filter(F.split("payload", f"(?={start})"), lambda c: c.rlike(f"^{start}")))

    begun = F.coalesce(*map(cut, starts))
    rows = df.where("payload is not null").select(F.posexplode(F.filter(begun, lambda c: c.rlike(link))).alias("n", "c"))
    href = html.plain(F.regexp_extract("c", link, 1))
    url = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(href, F.lit("/"))))
    rows = rows.select("n", F.lit(site).alias("site"), url.alias("job_url"), *[F.nullif(html.plain(F.regexp_extract("c", p, 1)), F.lit("")).alias(n) for n, p in fields.items()])
    found = F.nullif(F.regexp_extract("job_url", own_id, 1), F.lit(""))
    rows = rows.withColumn("id", F.concat(F.lit(f"{site[:2]}-"), F.coalesce(found, F.substring(F.sha2("job_url", 256), 1, 16))))
    return rows.groupBy("id").agg(F.min_by(F.struct("site", "job_url", *fields), "n").alias("r")).select("id", "r.*")


# Marks of cards, fields and links on the boards' pages.
LINKEDIN = {"title": "(?s)<span[^>]*sr-only[^>]*>(.*?)</span>", "company": "(?s)<h4[^>]*base-search-card__subtitle[^>]*>(.*?)</h4>", "company_url": '(?s)<h4[^>]*base-search-card__subtitle[^>]*>.*?href="([^"?]*)', "location": "(?s)<span[^>]*job-search-card__location[^>]*>(.*?)</span>", "date_posted": '(?s)<time[^>]*job-search-card__listdate[^>]*datetime="([^"]*)"', "pay": "(?s)<span[^>]*job-search-card__salary-info[^>]*>(.*?)</span>"}
BAYT = {"title": "(?s)<h2[^>]*>(.*?)</h2>", "company": "(?s)t-nowrap[^>]*>(.*?)</div>", "location": "(?s)t-mute[^>]*>(.*?)</div>"}
BDJOBS = {"title": '(?si)<a[^>]*href="[^"]*jobdetail[^"]*"[^>]*>(.*?)</a>', "title_text": "(?s)job-title-text[^>]*>(.*?)</", "company": "(?s)comp-name-text[^>]*>(.*?)</", "location": "(?s)locon-text[^>]*>(.*?)</", "experience_range": "(?s)exp-text[^>]*>(.*?)</"}
BDJOBS_CARDS = tuple(f'<div[^>]*class="[^"]*\\b{c}(?![\\w-])' for c in ("job-item", "sout-jobs-wrapper", "norm-jobs-wrapper", "featured-wrap")) + ('(?i)<a[^>]*href="[^"]*jobdetail',)
GOOGLE_JOBS = '(?s)520084652":(\\[.*?\\]\\s*])\\s*}\\s*]\\s*]\\s*]\\s*]\\s*]'
GOOGLE = {"title": "$[0]", "company": "$[1]", "location": "$[2]", "job_url": "$[3][0][0]", "age": "$[12]", "description": "$[19]", "own": "$[28]"}


def linkedin(df: DataFrame) -> DataFrame:
    rows = cards(df, "linkedin", ('<div[^>]*class="[^"]*\\bbase-search-card(?![\\w-])',), LINKEDIN, 'href="([^"?]*)', "https://www.linkedin.com", "(\\d+)/?$")
    place, pay = S.location_parts(F.col("location")), S.salary_range(F.col("pay"))
    rows = rows.withColumns({"place": place, "money": pay})
    return rows.select("id", "site", "job_url", "title", "company", "company_url", F.coalesce(S.location_display(F.col("place.city"), F.col("place.state"), F.col("place.country")), "location").alias("location"), "date_posted", F.col("money.min_amount").alias("min_amount"), F.col("money.max_amount").alias("max_amount"), F.col("money.interval").alias("interval"), F.col("money.currency").alias("currency"))


def bayt(df: DataFrame) -> DataFrame:
    return cards(df, "bayt", ("<li[^>]*data-js-job",), BAYT, 'href="([^"]*)"', "https://www.bayt.com", "-(\\d+)/?$")


def bdjobs(df: DataFrame) -> DataFrame:
    """Cards by the first selector that a page has, else every link to a job's page."""
    rows = cards(df, "bdjobs", BDJOBS_CARDS, BDJOBS, '(?i)href="([^"]*jobdetail[^"]*)"', "https://jobs.bdjobs.com", "(?i)jobid=([^&]+)")
    return rows.withColumn("title", F.coalesce("title", "title_text", F.lit("N/A"))).drop("title_text")


def google(df: DataFrame, as_of: Column) -> DataFrame:
    """Pages that carry their jobs as keyed JSON arrays; of one URL the first stays."""
    found = df.select(F.posexplode(F.regexp_extract_all("payload", F.lit(GOOGLE_JOBS), 1)).alias("n", "j")).select("n", F.try_parse_json("j").alias("v")).where("v is not null")
    rows = found.select("n", *[F.try_variant_get("v", path, "string").alias(n) for n, path in GOOGLE.items()]).where("job_url is not null")
    rows = rows.groupBy("job_url").agg(F.min_by(F.struct("title", "company", "location", "age", "description", "own"), "n").alias("r")).select("job_url", "r.*")
    place = S.location_parts(F.col("location"))
    return rows.select(
        F.lit("google").alias("site"), F.concat(F.lit("go-"), "own").alias("id"), "title", "company", F.coalesce(S.location_display(place["city"], place["state"], place["country"]), "location").alias("location"), "job_url",
        S.days_ago(F.col("age"), as_of).alias("date_posted"), "description", S.is_remote(F.col("description")).alias("is_remote"),
    )


#: Boards and their readers; more can be added. Readers with a date argument get the day of collection.
READERS: dict[str, Callable[..., DataFrame]] = {"indeed": indeed, "naukri": naukri, "zip_recruiter": ziprecruiter, "glassdoor": glassdoor, "linkedin": linkedin, "bayt": bayt, "bdjobs": bdjobs, "google": google}


def flat(df: DataFrame, enforce_annual: bool = False) -> DataFrame:
    """A board's rows with all flat columns: salary from the description if the board gave none, addresses, job types."""
    have = lambda n: F.col(n) if n in df.columns else F.lit(None)
    found = S.salary_range(have("description").cast("string"))
    given = have("min_amount").isNotNull()
    money = {"interval": F.when(given, have("interval").cast("string")).otherwise(found["interval"]), "currency": F.when(given, have("currency").cast("string")).otherwise(found["currency"])}
    for c in ("min_amount", "max_amount"):
        amount = F.when(given, have(c).cast("double")).otherwise(found[c].cast("double"))
        money[c] = S.annual(amount, money["interval"]) if enforce_annual else amount
    if enforce_annual:
        money["interval"] = F.when(money["min_amount"].isNotNull(), "yearly")
    own = money | {
        "salary_source": F.when(given, "direct_data").when(found.isNotNull(), "description"),
        "emails": F.array_join(S.emails(have("description").cast("string")), ", "),
        "job_type": F.coalesce(have("job_type").cast("string"), F.nullif(F.array_join(S.job_types(have("description").cast("string")), ", "), F.lit(""))),
        "date_posted": S.iso_date(have("date_posted").cast("string")),
        "is_remote": have("is_remote").cast("boolean"),
    }
    return df.select(*[(own[c] if c in own else have(c).cast("string")).alias(c) for c in FLAT])


@dataclass(frozen=True)
class Options:
    """What a collection wants; an empty value wants all.

    results_wanted and offset count within each board, newest first; hours_old goes back from the day of collection, to
    whole days; job_type and country may be any of their names, and unknown ones are errors.
    """

    sites: tuple[str, ...] = ()
    results_wanted: int | None = None
    offset: int = 0
    hours_old: int | None = None
    job_type: str = ""
    country: str = ""
    is_remote: bool = False

    def __post_init__(self):
        if self.job_type and not any(_bare(self.job_type) in own for own in L.JOB_TYPES):
            raise ValueError(f"unknown job type {self.job_type!r}")
        if self.country and not any(self.country.strip().lower() in own for own in L.COUNTRIES):
            raise ValueError(f"unknown country {self.country!r}")
        if self.sites and (unknown := set(self.sites) - set(READERS)):
            raise ValueError(f"unknown boards {sorted(unknown)}")


def _bare(name: str) -> str:
    return name.lower().translate(str.maketrans("", "", " _-"))


def wanted(rows: DataFrame, options: Options, as_of: Column) -> DataFrame:
    """The rows of the flat frame that the options want.

    A row without a date is as old as can be if an age is asked for; one of several job types has each of them; the country is the last part
    of the location, and a row whose location names none is of any.
    """
    types = F.transform(F.split(F.coalesce("job_type", F.lit("")), ","), S.job_type)
    place = S.country(F.element_at(F.split(F.coalesce("location", F.lit("")), ","), -1))
    asked = next((own[0] for own in L.COUNTRIES if options.country.strip().lower() in own), None)
    kind = next((own[0] for own in L.JOB_TYPES if _bare(options.job_type) in own), None) if options.job_type else None
    rows = rows.where(
        both(
            F.col("site").isin(*options.sites) if options.sites else None,
            F.coalesce(F.col("date_posted") >= F.timestamp_add("HOUR", F.lit(-options.hours_old), as_of.cast("timestamp")).cast("date"), F.lit(False)) if options.hours_old is not None else None,
            F.array_contains(types, kind) if kind else None,
            F.coalesce(place == asked, F.lit(True)) if asked and asked != "worldwide" else None,
            F.coalesce("is_remote", F.lit(False)) if options.is_remote else None,
        )
    )
    if options.results_wanted is None and not options.offset:
        return rows
    nth = F.row_number().over(Window.partitionBy("site").orderBy(F.desc_nulls_last("date_posted"), "id"))
    last = options.offset + options.results_wanted if options.results_wanted is not None else None
    rows = rows.withColumn("_nth", nth).where(F.col("_nth") > options.offset)
    return (rows.where(F.col("_nth") <= last) if last is not None else rows).drop("_nth")


def collect(spark: SparkSession, paths: dict[str, str], as_of: Column, enforce_annual: bool = False, options: Options = Options()) -> DataFrame:
    """The wanted rows of all boards' landed files (JSON lines with a payload), newest first within a board."""
    out = None
    for site, path in paths.items():
        if options.sites and site not in options.sites:
            continue
        raw, reader = spark.read.schema("payload string").json(path), READERS[site]
        rows = flat(reader(raw, as_of) if reader in (naukri, glassdoor, google) else reader(raw), enforce_annual)
        out = rows if out is None else out.unionByName(rows)
    return wanted(out, options, as_of).orderBy("site", F.desc_nulls_last("date_posted"))
