"""URL filter: host rules, and a weighted vocabulary counted by Aho-Corasick with boundary checks.

A rule `host/path` fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins. Urls
without a fitting rule are judged by words: a term counts where no ASCII letter touches it, and a stem counts once, however
many of its forms stand in the url. The weights of its distinct stems add up, and `limit` rejects it: a strict stem has that
weight alone; soft ones of two classes that innocent sites rarely name reach it in twos, those of everyday words only in
threes (pharmacy, malware, piracy, scam), fours (ads) or fives (sales), as `/patch/mirror` and `/sale/offer/trial` are
common paths.

Cases: a null url, or one without `://`, has an empty host and path, so no rule fits; a null url has no terms and is
allowed; repeated rows each get a row; an empty table gives an empty result; other columns are carried by `judge` only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import free_name, table

#: (verdict, rule) of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: By class: the weight of a soft stem, stems that reject alone, stems that count as soft. A `-` in a stem may be written as `_` or left out.
CLASSES = {
    "adult": (0.5, """porn porno pornhub pornstar pornofilm pornovideo videoporno xxx xvideos xnxx xhamster redtube youporn brazzers chaturbate sexcam sextape sexchat sexshop
        sexfilm sexfilme livesex hentai futanari camgirl milf nsfw bdsm striptease erotica blowjob creampie gangbang cumshot deepthroat threesome upskirt bukkake dildo
        swingerclub fickfilm nutten telefonsex bordell sexkontakte putas culonas tetonas porrno pornodoido bokep ngentot memek bugil film-x""".split(),
              """adult nude naked sexy sex cam webcam dating single lingerie hottest babe escort fetish hookup voyeur swinger onlyfans erotik erotic erotico erotique sexo sesso nackt
        nackte nudist topless boobs busty teens playmate strip kinky massage-parlor rencontre flirt casual-dating playboy seitensprung coquine""".split()),
    "gambling": (0.5, """casino kasino roulette blackjack baccarat sportsbook bookmaker bookie togel judi sbobet slotgacor bandarq dominoqq pokerqq videopoker pokies sweepstake spielbank
        spielothek sportwetten gluecksspiel spielautomat apuestas apostas tragaperras tragamonedas scommesse paris-sportifs machine-a-sous bwin betway betfair 1xbet bet365 pokerstars
        casa-de-apuestas kumarhane totobet""".split(),
                 """bet betting poker slot jackpot bingo odds wager gamble gambling lottery lotto lotterie loteria loterie tombola craps freispiele freespin spins parlay tipster wette
        wetten toto keno bankroll highroller croupier""".split()),
    "pharmacy": (0.4, """viagra cialis levitra sildenafil tadalafil vardenafil kamagra xanax tramadol oxycontin oxycodone hydrocodone percocet vicodin modafinil phentermine klonopin ambien valium
        clomid nolvadex dianabol potenzmittel adderall no-prescription ohne-rezept sin-receta sans-ordonnance""".split(),
                 """pill pharmacy pharma prescription dosage supplement slimming detox steroid anabolic erectile potency apotheke farmacia pharmacie rezeptfrei medikament generika
        painkiller opioid testosterone hgh weightloss diet keto garcinia abnehmen adelgazar maigrir nootropic""".split()),
    "malware": (0.34, """exploitkit keylogger fudcrypter ratbuilder ransomware-builder stealer-logs botnet-rental carding cvv-shop fullz bank-logs ddos-booter stresser skimmer-shop""".split(),
                """malware phishing ransomware trojan botnet spyware exe dropper payload unlocker antivirus cleaner driver-update pc-repair speedup registry-fix scareware
        rootkit crypter exploit shellcode backdoor apk-mod toolbar codec-pack flash-update""".split()),
    "piracy": (0.34, """warez keygen serialz nulled camrip torrentz piratebay thepiratebay 1337x rarbg kickass-torrents putlocker fmovies 123movies solarmovie gomovies streamcloud kinox movie4k
        cuevana pelisplus repelis filmpalast cracksite getintopc skidrow codex-repack fitgirl-repack iptv-premium dvdscr telesync""".split(),
               """crack cracked serial patch rip mirror streaming modapk unlocked torrent magnet-link activator repack bluray dvdrip webrip hdrip 1080p x264 subbed dubbed
        gratis-film pelicula-completa film-complet descargar telecharger kostenlos-ansehen iptv rapidgator uploaded megaupload""".split()),
    "scam": (0.34, """payday-loan bitcoin-doubler crypto-doubler double-your-bitcoin get-rich-quick moneymule giftcard-generator robux-generator free-robux vbucks-generator
        money-glitch advance-fee nigerian-prince work-from-home-cash binary-options-robot kredit-ohne-schufa""".split(),
             """loan crypto forex giveaway win winner bonus cashback prize earn mining airdrop ponzi pyramid binary-options signals investment passive-income rich millionaire
        kredit darlehen gewinn gewinnspiel prestamo ganar dinero credit-rapide gagner urgent inheritance lucky claim reward token presale doubler""".split()),
    "ads": (0.25, """adserver doubleclick popunder adclick clickbank adtracker popads propellerads exoclick trafficjunky adsterra adnxs adform taboola outbrain revcontent zedo
        clickadu hilltopads adcash juicyads plugrush adskeeper""".split(),
            """ad tracker tracking click affiliate popup banner sponsor redirect utm spam promoted referral impression cpm cpc ppc pixel beacon syndication werbung anzeige
        publicidad publicite partnerlink clickbait""".split()),
    "sales": (0.2, (), """free cheap promo deal discount coupon offer sale buy-now limited trial voucher rabatt gutschein angebot billig gratis kostenlos guenstig oferta descuento barato
        rebajas cupon soldes remise pas-cher promotion sconto offerta murah diskon clearance bargain wholesale replica outlet lowest-price order-now shop-now exclusive hurry""".split()),
}
#: Words that are written together with a strict stem of these classes, before and behind it.
BEFORE, BEHIND, TOGETHER = ("free", "online", "best", "live", "top", "my"), ("online", "free", "live", "club", "bonus", "hub"), ("adult", "gambling", "pharmacy")
LIMIT = 1.0


def vocabulary(classes: dict[str, tuple] = CLASSES) -> dict[str, tuple[str, float]]:
    """Term -> (stem, weight): every stem, its plural, and strict stems written together with what advertises them. A stem of several words has each of its joints.

    A term in which another of no less weight stands between bounds is left out: wherever it hits, so does that.
    """
    plural = lambda w: w if w.endswith(("s", "x", "z", "ing", "y")) or not w[-1].isalpha() else w + "s"
    out: dict[str, tuple[str, float]] = {}
    for name, (weight, strict, soft) in classes.items():
        for stems, w in ((soft, weight), (strict, LIMIT)):
            for stem in stems:
                forms = {stem.replace("-", gap) for gap in ("-", "_", "")}
                forms |= {plural(f) for f in forms}
                if w == LIMIT and name in TOGETHER and "-" not in stem:
                    forms |= {a + stem for a in BEFORE} | {stem + z for z in BEHIND}
                for f in sorted(forms):
                    if w >= out.get(f, ("", 0.0))[1]:
                        out[f] = (stem, w)
    parts = {t: [p for p in re.split("[^a-z]+", t) if p != t] for t in out}
    return {t: (stem, w) for t, (stem, w) in out.items() if not any(out.get(p, ("", 0.0))[1] >= w for p in parts[t])}


VOCABULARY = vocabulary()


def host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A to Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_col: Column, path_col: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (verdict, rule), else null; rules of equal length go by their text."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host_col == own) | host_col.endswith("." + own)) & path_col.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def matcher(words: dict[str, tuple[str, float]]):
    """A function of a url: its distinct terms, sorted."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in words:
        automaton.add_word(term, term)
    automaton.make_automaton()

    def terms(url: str | None) -> list[str]:
        if not url:
            return []
        text, found = url.lower(), set()
        edge = lambda k: not (0 <= k < len(text) and text[k].isascii() and text[k].isalpha())
        for last, term in automaton.iter(text):
            if edge(last + 1) and edge(last - len(term)):
                found.add(term)
        return sorted(found)

    return terms


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, words: dict[str, tuple[str, float]] | None = None, limit: float = LIMIT,
          url_col: str = "url", out: str = "url_verdict") -> DataFrame:
    """pages with one more struct column `out`: host, path, rule, terms, weight (that of their stems), verdict (allow or block)."""
    words = VOCABULARY if words is None else words

    @F.pandas_udf("terms array<string>, weight double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = matcher(words) if words else (lambda u: [])
        for urls in parts:
            found = [find(u) for u in urls]
            yield pd.DataFrame({"terms": found, "weight": [round(sum(w for _, w in {words[t] for t in x}), 6) for x in found]})

    keep = [F.col(f"`{c}`") for c in pages.columns]
    u, names = F.col(f"`{url_col}`"), {k: free_name(pages, k) for k in ("_host", "_path", "_terms", "_rule")}
    df = pages.select(*keep, host(u).alias(names["_host"]), path(u).alias(names["_path"]), told(u).alias(names["_terms"]))
    df = df.select("*", rule_of(F.col(names["_host"]), F.col(names["_path"]), rules).alias(names["_rule"]))
    found, rule = F.col(names["_terms"]), F.col(names["_rule"])
    verdict = F.coalesce(rule["verdict"], F.when(found["weight"] >= limit, "block").otherwise("allow"))
    return df.select(*keep, F.struct(F.col(names["_host"]).alias("host"), F.col(names["_path"]).alias("path"), rule["rule"].alias("rule"),
                                     found["terms"].alias("terms"), found["weight"].alias("weight"), verdict.alias("verdict")).alias(free_name(pages, out)))


def query(spark, sf_dir) -> DataFrame:
    """op8: host, path, rule and verdict of every page."""
    v = F.col("url_verdict")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", *[v[c].alias(c) for c in ("host", "path", "rule", "verdict")])


_TERMS = ", ".join(f"('{t}', '{stem}', {w})" for t, (stem, w) in sorted(VOCABULARY.items()))
SQL = rf"""
WITH v(term, stem, weight) AS (VALUES {_TERMS}), p AS (
    SELECT page_id, coalesce(url, '') AS url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), t AS (
    SELECT url, round(sum(weight), 6) AS weight FROM (
        SELECT url, stem, weight FROM (SELECT DISTINCT url, unnest(string_split_regex(lower(url), '[^a-z]+')) AS term FROM p) JOIN v USING (term)
        UNION SELECT url, stem, weight FROM (SELECT DISTINCT url FROM p) JOIN (SELECT * FROM v WHERE regexp_matches(term, '[^a-z]')) v
            ON contains(lower(url), term) AND regexp_matches(lower(url), '(^|[^a-z])' || term || '($|[^a-z])')) GROUP BY url
), r AS (
    SELECT p.*, coalesce(weight, 0) AS weight, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM p LEFT JOIN t USING (url)
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
