"""URL and domain identity: hosts, registrable domains, blocked domains, tracking parameters, article paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.basics import bind

# Domains, suffixes, patterns.
PLATFORM_ROOTS = ["wordpress.com", "substack.com", "github.io", "blogspot.com", "ghost.io", "write.as", "bearblog.dev", "mataroa.blog", "omg.lol"]
TWO_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "co.in", "com.au", "co.nz", "com.br", "co.za", "com.mx", "com.sg", "com.tr"]
BLOCKED_TLDS = [".gov", ".mil", ".edu", ".ac.uk"]
BLOCKED_DOMAINS = """
nytimes.com washingtonpost.com wsj.com ft.com economist.com bloomberg.com theguardian.com thetimes.co.uk
telegraph.co.uk cnn.com foxnews.com msnbc.com nbcnews.com cbsnews.com abcnews.go.com apnews.com reuters.com bbc.co.uk
bbc.com aljazeera.com time.com newsweek.com usatoday.com theatlantic.com newyorker.com politico.com axios.com slate.com
salon.com thedailybeast.com dailybeast.com nypost.com dailymail.co.uk thesun.co.uk mirror.co.uk latimes.com
chicagotribune.com sfchronicle.com bostonglobe.com seattletimes.com npr.org pbs.org dw.com france24.com abc.net.au
cbc.ca yahoo.com msn.com news.yahoo.com
wired.com arstechnica.com theverge.com techcrunch.com engadget.com gizmodo.com mashable.com lifehacker.com cnet.com
zdnet.com pcworld.com macrumors.com 9to5mac.com tomshardware.com anandtech.com theinformation.com
semianalysis.substack.com slashdot.org theregister.com venturebeat.com readwrite.com thenextweb.com sifted.eu
forbes.com businessinsider.com insider.com cnbc.com fortune.com inc.com fastcompany.com hbr.org marketwatch.com
investopedia.com barrons.com benzinga.com seekingalpha.com fool.com zerohedge.com
buzzfeed.com huffpost.com vox.com medium.com hackernoon.com dev.to freecodecamp.org towardsdatascience.com
betterprogramming.pub levelup.gitconnected.com uxdesign.cc geeksforgeeks.org tutorialspoint.com w3schools.com
stackoverflow.com stackexchange.com quora.com reddit.com linkedin.com facebook.com twitter.com x.com instagram.com
tiktok.com youtube.com youtu.be pinterest.com wikipedia.org github.com gitlab.com apple.com microsoft.com google.com
blog.google openai.com anthropic.com deepmind.google meta.com netflixtechblog.com eng.uber.com netflix.com amazon.com
dropbox.tech discord.com slack.com engineering.fb.com aws.amazon.com azure.microsoft.com
developer.mozilla.org learn.microsoft.com docs.oracle.com developer.apple.com developer.android.com
code.visualstudio.com
news.ycombinator.com hnrss.org hn.algolia.com techmeme.com mediagazer.com memex.marginalia.nu lobste.rs tildes.net
kagi.com
addtoany.com addthis.com sharethis.com disqus.com buffer.com hootsuite.com paper.li scoop.it bloglovin.com
feedburner.com feedspot.com flipboard.com buttondown.email mailchimp.com mailchi.mp sendfox.com gravatar.com patreon.com
ko-fi.com gumroad.com buymeacoffee.com
akismet.com surveymonkey.com typepad.com huggingface.co libertyfund.org cloudflare.com automattic.com jetpack.com
tenable.com atlassian.com sentry.io datadoghq.com
cepr.org voxeu.org ourworldindata.org quillette.com nber.org ssrn.com scholar.google.com
reason.com 404media.co eff.org epic.org worksinprogress.co thedailyeconomy.org prospect.org americanaffairsjournal.org
compactmag.com unherd.com unsplash.com wordcamp.org wp.me
wordpress.com wordpress.org
""".split()
NON_ARTICLE_EXTENSIONS = ".pdf .jpg .jpeg .png .gif .webp .svg .zip .tar.gz .mp3 .mp4 .mov .wav .iso .dmg .exe .deb .whl .jar .gz .xz .7z .csv .json .xml".split()
LIST_PATHS = r"/(tag|tags|category|categories|author|archive|page|search)/"
TRACKING = r"(?i)^(utm_|fbclid$|gclid$|mc_cid$|mc_eid$|ref_src$|ref_url$|cmpid$|spm$|igshid$|si$)"
#: Parts of an absolute URL: scheme, authority, path, query, fragment.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, k)


def host(url: Column) -> Column:
    """Lower-cased authority without user part; null for what is no absolute URL."""
    found = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    found = _part(url, 3)
    return F.when(_part(url, 1) == "", None).otherwise(F.when(found == "", "/").otherwise(found))


def without_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def root_domain(h: Column) -> Column:
    """Registrable domain of a host: two labels, three for the known two-part suffixes, all on a publishing platform."""

    def of(name: Column) -> Column:
        two = F.substring_index(name, ".", -2)
        return F.when(two == name, name).when(two.isin(PLATFORM_ROOTS), name).when(two.isin(TWO_PART_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)

    return bind(without_www(h), of)


def classify(url_or_domain: Column) -> Column:
    """struct<allowed, reason>: whether a site may be a source."""

    def judged(name: Column, root: Column) -> Column:
        blocked_root, blocked_name = root.isin(BLOCKED_DOMAINS), name.isin(BLOCKED_DOMAINS)
        blocked = (blocked_root | blocked_name) & (~root.isin(PLATFORM_ROOTS) | (name == root) | blocked_name)
        reason = F.when((name == "") | ~name.contains("."), "not a domain")
        for tld in BLOCKED_TLDS:
            reason = reason.when(name.endswith(tld), f"blocked tld {tld}")
        return reason.when(blocked, "blocked domain").otherwise("")

    name = without_www(F.coalesce(host(url_or_domain), F.lower(F.trim(url_or_domain))))
    reason = bind(name, lambda n: bind(F.struct(n.alias("n"), root_domain(n).alias("r")), lambda x: judged(x["n"], x["r"])))
    return bind(reason, lambda r: F.struct((r == "").alias("allowed"), r.alias("reason")))


def is_article_path(url: Column) -> Column:
    """An http(s) URL with a path that is no file and no list page."""
    files = "(" + "|".join(x.replace(".", r"\.") for x in NON_ARTICLE_EXTENSIONS) + ")$"
    fits = bind(F.lower(path(url)), lambda where: (where != "/") & ~where.rlike(files) & ~where.rlike(LIST_PATHS))
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & (_part(url, 2) != "") & fits, F.lit(False))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters and, if it had any, without its fragment; else the URL as it is."""
    name = F.lower(_part(url, 2))
    medium = (name == "medium.com") | name.endswith(".medium.com")

    def tracking(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        return key.rlike(TRACKING) | (medium & (key == "source"))

    query = _part(url, 4)
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    left = F.array_join(F.filter(pairs, lambda p: ~tracking(p)), "&")
    bare = F.concat(F.lower(_part(url, 1)), F.lit("://"), name, path(url), F.when(left == "", "").otherwise(F.concat(F.lit("?"), left)))
    return F.when((query != "") & F.exists(pairs, tracking), bare).otherwise(url)


def entry_url(url: Column) -> Column:
    """A feed entry's URL: http(s) only, no fragment, no tracking parameters; else the empty string."""
    trimmed = F.trim(url)
    return F.when(trimmed.rlike("(?i)^https?://"), strip_tracking(F.substring_index(trimmed, "#", 1))).otherwise("")


def candidate(url: Column) -> Column:
    """struct<site_url, domain, path> of a discovered link, null for other schemes."""
    where = F.regexp_replace(path(url), "/+$", "")
    parts = F.filter(F.split(where, "/", -1), lambda s: s != "")
    # One alternation for the whole first segment, as the product has it: only its first and last part are anchored.
    section = F.when((F.size(parts) > 1) & F.get(parts, F.lit(0)).rlike("^blog|writing|posts|articles|essays|notes$"), F.slice(parts, 1, 1)).otherwise(F.slice(parts, 1, 0))
    kept = F.when((F.size(parts) > 0) & ~is_article_path(url), parts).otherwise(section)
    scheme = F.lower(_part(url, 1))
    site = F.concat(scheme, F.lit("://"), host(url), F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & host(url).isNotNull(), F.struct(site.alias("site_url"), without_www(host(url)).alias("domain"), where.alias("path")))
