"""Well-known hosts, as a person labels them: what the default training table of the URL filter is made of.

Each line is a stem, which is held out as a whole in tests, and hosts that belong to it.
"""

#: Hosts of adult content, gambling, pills, loans, piracy, gaudy advertising and link farms.
BLOCKED = """
porn: pornhub.com youporn.com redtube.com porntube.com porndude.com beeg.com spankbang.com
xvid: xvideos.com xnxx.com xhamster.com xtube.com xxxbunker.com txxx.com
cams: chaturbate.com livejasmin.com bongacams.com stripchat.com camsoda.com myfreecams.com cam4.com
sex: sexvideos.tube sexlikereal.com hotsex.tv
adult: adultfriendfinder.com adultempire.com adulttime.com adultwork.com adultdvdempire.com adultsearch.com
fans: onlyfans.com fansly.com manyvids.com clips4sale.com
tube: tube8.com tnaflix.com drtuber.com hclips.com
bet: bet365.com betfair.com betway.com betsson.com unibet.com sportsbet.io freebets.com 1xbet.com parimatch.com
casino: casino.com 888casino.com leovegas.com casumo.com vegascasino.io casinoroom.com royalpanda.com jackpotcity.com
poker: pokerstars.com partypoker.com ggpoker.com 888poker.com wsop.com
slots: slotomania.com slots.lv bovada.lv stake.com roobet.com spinpalace.com
win: bwin.com winamax.fr ladbrokes.com williamhill.com paddypower.com draftkings.com fanduel.com
jack: blackjack-777.win blackjackclub.net roulette77.com
pills: cheap-pills.net viagra-online.biz buycialis.info canadianpharmacy.top pharmacy2u-deals.biz
loan: fastpayday.loans paydayloans.biz quickcash-loans.info cashadvance.top
money: free-money.biz getrich-quick.info earnfast-online.top doubleyourbitcoin.biz
piracy: thepiratebay.org 1337x.to rarbg.to kickasstorrents.cr yts.mx fmovies.to putlocker.is 123movies.la
spam: spamfarm.biz link-farm.info bestseo-links.top cheapbacklinks.biz clickbait-news.top
ads: doubleclick.net popads.net propellerads.com adsterra.com exoclick.com trafficjunky.net ads-tracker.biz
replica: replicawatches.biz cheapreplicas.ru rolex-outlet.top
hook: ashleymadison.com hookupnow.xxx sugardaddy-meet.biz
""".strip().splitlines()

#: Hosts of reference, learning, news, public bodies, science, trade, travel and code.
ALLOWED = """
wiki: wikipedia.org wiktionary.org wikidata.org wikisource.org fandom.com
code: github.com gitlab.com stackoverflow.com python.org apache.org kernel.org sourceforge.net npmjs.com
news: bbc.co.uk nytimes.com theguardian.com reuters.com lemonde.fr spiegel.de elpais.com washingtonpost.com apnews.com
state: nasa.gov nih.gov europa.eu gov.uk loc.gov un.org who.int bundestag.de service-public.fr
school: mit.edu stanford.edu harvard.edu ox.ac.uk khanacademy.org coursera.org edx.org
paper: arxiv.org nature.com sciencedirect.com jstor.org springer.com plos.org pubmed.ncbi.nlm.nih.gov
books: gutenberg.org archive.org goodreads.com openlibrary.org barnesandnoble.com
shop: amazon.com ebay.com etsy.com ikea.com walmart.com target.com
travel: hotels.com booking.com tripadvisor.com lonelyplanet.com expedia.com airbnb.com bahn.de
food: allrecipes.com bbcgoodfood.com seriouseats.com epicurious.com chefkoch.de
health: mayoclinic.org webmd.com nhs.uk healthline.com medlineplus.gov
weather: weather.com weather.gov accuweather.com meteofrance.com
sport: espn.com fifa.com nba.com skysports.com olympics.com
music: spotify.com musicbrainz.org discogs.com bandcamp.com
film: imdb.com rottentomatoes.com letterboxd.com
money: economist.com ft.com bloomberg.com worldbank.org imf.org investopedia.com
garden: gardenersworld.com rhs.org.uk thespruce.com
map: openstreetmap.org maps.google.com mapbox.com
mind: medium.com wordpress.org blogger.com quora.com reddit.com
tech: microsoft.com apple.com ibm.com mozilla.org intel.com w3.org ietf.org
museum: louvre.fr britishmuseum.org metmuseum.org smithsonian.si.edu
law: law.cornell.edu justia.com legifrance.gouv.fr oyez.org
""".strip().splitlines()


def stems(lines: list[str]) -> dict[str, list[str]]:
    return {name: hosts.split() for name, hosts in (line.split(":", 1) for line in lines)}
