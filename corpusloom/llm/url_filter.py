"""URL filter: rules first, then logistic regression on hashed character n-grams (SQL functions only).

The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path goes
on from there up to "?", "#" or the end. A rule (host, path) fits its host and all subdomains if the
path starts with the rule's path; of several the longest wins. Where no rule fits, four-character
grams of host and path hash to BUCKETS integer weights, and the sum decides.

The weights are fitted on the small labelled table below (bounded by its length, in plain Python, on the driver; 80 hosts to
block and 100 ordinary ones, none from the given tables) and rounded to integers, so that every engine gives the same verdict.

Defined cases: a null url, or one without "://", has empty host and path and is judged by the model's
intercept; ties of the score (sum 0) are allowed; repeated rows are judged row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

BUCKETS = 4096
GRAM = 4
BASE = 131
SCALE = 1_000_000
#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The labelled table, by kind: hosts to block, and ordinary ones of many countries and sizes.
BLOCKED = (
    "luckyspins.casino", "megaslots.bet", "royalroulette.net", "pokerkings.io", "jackpotcity-play.com", "sportbetting24.ru", "1xbet-zerkalo.site", "onlinecasinos-top.info", "blackjacktables.co", "bingo-bonus.uk",
    "spinandwin.club", "betwinner-promo.top", "casinobonus247.net", "livecasinogames.tv", "slotmachine-fun.online", "parlaybets.us", "dicegamble.biz", "baccarat-vip.asia", "freespins-nodeposit.eu", "bets4you.mobi",
    "canadian-pharmacy-meds.com", "viagra-cialis-rx.biz", "genericpills.su", "order-tramadol.info", "weightloss-pills.shop", "buyxanaxonline.to", "discountmeds4u.net", "rx-nolicense.ru", "steroids-store.pw", "diet-keto-gummies.store",
    "hgh-tablets.click", "levitra-discount.in", "freepornvideos.xxx", "hotsexcams.com", "xxx-clips.sex", "adultdating-local.net", "nudegirls-live.cam", "escort-city.date", "hentai-stream.top", "milf-chat.club",
    "erotic-stories.adult", "pornhd.video", "camgirls.webcam", "sexshop-toys.biz", "fetishclips.org", "adultfriends.mobi", "adserver.mediabuy.net", "ads.clickbank-network.com", "pixel.trackinghub.io", "doubletrack-ads.com",
    "popunder-ads.xyz", "banner-exchange.biz", "clickserve.adnet.co", "tracker.affiliate-cpa.com", "adsyndicate.net", "retarget.adpixel.eu", "push-notify-ads.site", "adclick-redirect.top", "impression-track.net", "affiliate-tracker.click",
    "cpmads.live", "claim-your-prize.click", "free-phone-winner.win", "bitcoin-doubler.fund", "crypto-giveaway.live", "fast-payday-loans.cash", "get-rich-quick.biz", "earn-from-home.icu", "seo-backlinks.ru", "buy-followers.shop",
    "linkfarm-directory.info", "spamblog-network.top", "bulkspam-mailer.cn", "replica-watches.cn", "free-gift-cards.gq", "instant-loan-approval.tk", "lottery-winner.ml", "forex-robot-profit.trade", "cracked-keygen.download", "warez-torrents.to",
)
ORDINARY = (
    "en.wikipedia.org", "docs.python.org", "github.com", "www.mit.edu", "arxiv.org", "www.gov.uk", "www.nasa.gov", "www.lemonde.fr", "www.spiegel.de", "elpais.com",
    "www.reuters.com", "apnews.com", "www.npr.org", "www.gutenberg.org", "developer.mozilla.org", "www.who.int", "data.census.gov", "www.britannica.com", "www.smithsonianmag.com", "www.bundestag.de",
    "www.louvre.fr", "www.museodelprado.es", "www.ox.ac.uk", "www.ethz.ch", "www.u-tokyo.ac.jp", "www.metoffice.gov.uk", "www.openstreetmap.org", "spark.apache.org", "www.debian.org", "blog.rust-lang.org",
    "www.ietf.org", "pandas.pydata.org", "www.mayoclinic.org", "www.nhs.uk", "pubmed.ncbi.nlm.nih.gov", "www.cdc.gov", "www.allrecipes.com", "www.lonelyplanet.com", "www.nps.gov", "lichess.org",
    "www.imdb.com", "pitchfork.com", "www.goodreads.com", "www.poetryfoundation.org", "www.economist.com", "hbr.org", "www.khanacademy.org", "www.ted.com", "www.espn.com", "www.olympics.com",
    "www.gardenersworld.com", "www.audubon.org", "www.redcross.org", "www.oxfam.org.uk", "www.bahn.de", "www.renfe.es", "www.amtrak.com", "www.ikea.com", "www.lego.com", "www.toyota.co.jp",
    "www.zeit.de", "www.lavanguardia.com", "www.liberation.fr", "www.aftonbladet.se", "www.nrc.nl", "www.corriere.it", "www.asahi.com", "www.abc.net.au", "www.cbc.ca", "www.stuff.co.nz",
    "www.irishtimes.com", "www.nzz.ch", "www.derstandard.at", "www.hs.fi", "www.aftenposten.no", "blog.annas-bakery.de", "joes-plumbing.com", "smalltown-library.org", "villageschool.sch.uk", "kletterverein-alpen.at",
    "fotoclub-hamburg.de", "choir-stmary.org", "mountainhiking.ch", "pottery-studio.fr", "beekeepers-guild.org.uk", "localhistory.wales", "oldtimer-freunde.de", "cafe-central.at", "gardening-tips.co.nz", "knittingpatterns.ca",
    "astronomy-club.au", "chess-school.in", "robotics-team.edu", "river-trust.scot", "quilting-circle.us", "sussex-cricket.co.uk", "middlesex-county.org", "m.tidetables.net", "forum.woodworking.net", "dancestudio.example.com",
)
#: Frames that hosts of both kinds share, so that a subdomain, a top-level domain or a path alone says little.
BEFORE = ("", "www.", "m.", "blog.", "en.")
AFTER = ("com", "net", "org", "de", "co.uk", "io", "fr", "example.com", "example.net", "example.org", "info")
PATHS = ("/", "/en/12", "/2021/05/a-title", "/index.html", "/de/44", "/article/7", "/fr/3", "/blog/post-9", "/es/61", "/en/507.html")
COPIES = 8


def labelled_urls() -> tuple[tuple[str, int], ...]:
    """(url, 1 to block): every labelled host as it is, and COPIES of its name in the frames in turn."""
    rows = []
    for hosts, y in ((BLOCKED, 1), (ORDINARY, 0)):
        for k, host in enumerate(hosts):
            rows.append((f"https://{host}{PATHS[k % len(PATHS)]}", y))
            name = max(host.split("."), key=len)
            for c in range(COPIES):
                n = k * COPIES + c
                rows.append((f"http://{BEFORE[n % len(BEFORE)]}{name}.{AFTER[n % len(AFTER)]}{PATHS[n * 3 % len(PATHS)]}", y))
    return tuple(rows)


HOST_PATH = "://([^/?#]*)([^?#]*)"


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:end], path[:stop]


def _grams(text: str, salt: int) -> list[int]:
    codes = [ord(c) for c in text]
    powers = [BASE ** (GRAM - 1 - k) for k in range(GRAM)]
    return [(sum(c * p for c, p in zip(codes[i : i + GRAM], powers)) + salt) % BUCKETS for i in range(len(codes) - GRAM + 1)]


def _features(host: str, path: str) -> list[int]:
    return _grams(f"^{host}$", 0) + _grams(path, 1777)


@lru_cache(1)
def weights(labelled: tuple | None = None, epochs: int = 200, rate: float = 0.1, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Intercept and bucket weights, in millionths, by stochastic gradient descent in a fixed order.

    Both labels weigh the same in all, so that the ordinary rows' number only says what to ignore.
    """
    w, bias = [0.0] * BUCKETS, 0.0
    rows = [(_features(*_split(u)), y) for u, y in labelled or labelled_urls()]
    bad = sum(y for _, y in rows)
    weigh = {0: len(rows) / 2 / max(1, len(rows) - bad), 1: len(rows) / 2 / max(1, bad)}
    order = sorted(range(len(rows)), key=lambda k: k * 7919 % len(rows))
    for epoch in range(epochs):
        step = rate / (1 + epoch / 20)
        for k in order:
            grams, y = rows[k]
            z = bias + sum(w[g] for g in grams) / 4
            error = weigh[y] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            bias -= step * error
            for g in grams:
                w[g] -= step * (error / 4 + decay * w[g])
    return round(bias * 4 * SCALE), tuple(round(x * SCALE) for x in w)


def host_path(url: Column) -> tuple[Column, Column]:
    host = ascii_lower(F.coalesce(F.regexp_extract(url, HOST_PATH, 1), F.lit("")))
    return host, F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def model_score(host: Column, path: Column) -> Column:
    """The sum of weights in millionths; above 0 means block."""
    bias, w = weights()
    wheel = F.array(*[F.lit(x) for x in w])

    def total(text: Column, salt: int) -> Column:
        codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

        def one(i):
            parts = [F.get(codes, i + k) * F.lit(BASE ** (GRAM - 1 - k)) for k in range(GRAM)]
            gram = sum(parts[1:], parts[0]) + F.lit(salt)
            return F.get(wheel, (gram % BUCKETS).cast("int")).cast("long")

        at = F.sequence(F.lit(0), F.char_length(text) - GRAM)
        sums = F.aggregate(F.transform(at, one), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.char_length(text) >= GRAM, sums).otherwise(F.lit(0).cast("long"))

    return total(F.concat(F.lit("^"), host, F.lit("$")), 0) + total(path, 1777) + F.lit(bias).cast("long")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. rules: at most a few hundred."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[1]))):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, name = F.when(fits, F.lit(v)).otherwise(rule), F.when(fits, F.lit(h + p)).otherwise(name)
    score = model_score(F.col("host"), F.col("path"))
    verdict = F.coalesce(rule, F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op7_sql() -> str:
    bias, w = weights()

    def total(text: str, salt: int) -> str:
        gram = " + ".join(f"unicode(substr({text}, i + {k}, 1))::BIGINT * {BASE ** (GRAM - 1 - k)}" for k in range(GRAM))
        return f"coalesce(list_sum(list_transform(range(1, length({text}) - {GRAM - 2}), lambda i: (SELECT w FROM w)[(({gram} + {salt}) % {BUCKETS} + 1)::INT])), 0)"

    whens = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[1])))
    )
    return f"""
WITH w AS MATERIALIZED (SELECT {list(w)}::BIGINT[] AS w),
u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{HOST_PATH}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{HOST_PATH}', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, '^' || host || '$' AS marked, CASE
{whens}
    END AS m FROM u),
s AS (SELECT r.*, {total("marked", 0).replace("(SELECT w FROM w)", "w.w")} + {total("path", 1777).replace("(SELECT w FROM w)", "w.w")} + {bias} AS score FROM r, w)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM s
"""
