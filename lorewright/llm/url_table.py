"""The small labelled URL table that the URL filter learns from, written by hand for this engine.

Both lists are of URLs as they are met on the web: hosts of many endings, with and without paths; the names of the unwanted ones are
made up in the manner of such sites (gambling, adult, pharmacy, loan, counterfeit, piracy, download traps, link farms, phishing), the
wanted ones are public institutions, media, reference works, shops, blogs and documentation. Both share endings and paths.
"""

UNWANTED = """
http://www.royal-vegas-slots.com/bonus/free-spins
https://casino-bonus-online.net/register?ref=8812
http://www.bestonlinepoker.org/en/signup
https://mega-jackpot-slots.info/play
http://bet365-mirror.top/sports/live
https://www.luckybets24.com/de/
http://roulette-winner.biz/strategy.html
https://sportsbetting-tips.xyz/odds/today
http://blackjack-live-dealer.net/
https://spin-and-win-casino.co/promo/100-free
http://slots-no-deposit.example.com/bonus-code
https://onlinecasinos-deutschland.example.de/bonus
http://apuestas-gratis.example.es/casino
https://paris-sportifs-gratuits.example.fr/bonus
http://www.hot-singles-tonight.com/chat
https://adult-cams-live.net/rooms/all
http://www.free-xxx-videos.example.org/watch/4412
https://sexy-webcam-girls.tv/
http://nude-celebs-leaked.info/gallery/12
https://escort-service-city.biz/profiles
http://www.milf-dating-club.com/join
https://porn-tube-hd.xyz/categories
http://local-hookups-now.net/?aff=77
https://erotik-kontakte.example.de/anzeigen
http://www.cheap-viagra-online.com/order
https://buy-cialis-no-prescription.net/checkout
http://canadian-pharmacy-discount.org/pills
https://weight-loss-miracle-pills.com/offer
http://generic-meds-24h.biz/cart?item=tramadol
https://keto-diet-gummies-official.shop/
http://testosterone-booster-deals.info/buy-now
https://cbd-oil-cheap.store/special
http://pillen-ohne-rezept.example.de/bestellen
https://www.payday-loans-instant.com/apply
http://fast-cash-advance-online.net/approval
https://bad-credit-loan-now.org/
http://www.forex-robot-profits.biz/signup
https://crypto-doubler-giveaway.io/claim
http://bitcoin-millionaire-system.com/start
https://make-money-from-home-fast.info/secret
http://binary-options-winner.net/demo
https://get-rich-quick-trading.xyz/landing
http://kredit-ohne-schufa-sofort.example.de/antrag
https://www.replica-rolex-watches.com/shop
http://www.cheap-nike-outlet-sale.net/shoes
https://louis-vuitton-replica-bags.org/store
http://fake-designer-handbags.biz/women
https://ray-ban-outlet-90off.shop/
http://wholesale-jerseys-china.com/nfl
https://discount-gucci-belts.store/sale
http://www.download-crack-keygen.com/photoshop
https://warez-full-version.net/games/pc
http://torrent-movies-free-hd.org/2023
https://serial-key-generator.info/windows
http://nulled-scripts-themes.xyz/wordpress
https://watch-movies-free-online.to/stream
http://www.mp3-free-downloads.biz/top100
https://apk-mod-unlimited-coins.com/hack
http://free-robux-generator.net/verify
https://vbucks-free-hack.org/human-check
http://gratis-musik-download.example.de/mp3
https://www.your-prize-is-waiting.com/claim?id=991
http://you-won-an-iphone.info/survey
https://free-gift-card-codes.net/amazon
http://survey-rewards-usa.biz/win
https://spin-the-wheel-prize.xyz/lp/3
http://congratulations-winner.top/
https://claim-your-reward-now.click/go
http://www.pc-virus-alert-support.com/call-now
https://update-flash-player-now.net/install.exe
http://driver-updater-free-scan.org/download
https://speed-up-your-pc.info/cleaner
http://secure-paypal-login-verify.com/account
https://appleid-confirm-account.net/signin
http://www.bank-account-suspended.info/update
https://netflix-billing-problem.xyz/login
http://amazon-order-refund.top/verify
https://www.buy-backlinks-cheap.com/packages
http://www.seo-link-farm.net/directory/free
https://www.buy-instagram-followers.org/prices
http://cheap-web-traffic.biz/buy-clicks
https://click-tracker-redirect.net/r?u=1
http://ads-popunder-network.com/serve
https://banner-adserver.example.net/track.gif
http://spam-mailer-software.info/bulk
https://www.best-essay-writing-cheap.com/order
http://buy-term-papers-online.net/
https://psychic-reading-free-minutes.com/call
http://gewinnspiel-iphone-gratis.example.de/
https://ganar-dinero-rapido.example.es/ya
"""

WANTED = """
https://www.city-library.org/catalogue/new
https://en.wikipedia.org/wiki/Photosynthesis
https://de.wikipedia.org/wiki/Fotosynthese
https://fr.wikipedia.org/wiki/Photosynth%C3%A8se
https://www.bbc.co.uk/news/world
https://www.lemonde.fr/planete/article/2023/
https://www.spiegel.de/wissenschaft/
https://elpais.com/ciencia/
https://www.nature.com/articles/s41586-020-2649-2
https://arxiv.org/abs/1706.03762
https://www.gutenberg.org/ebooks/1342
https://docs.python.org/3/library/json.html
https://spark.apache.org/docs/latest/sql-programming-guide.html
https://developer.mozilla.org/en-US/docs/Web/HTTP
https://stackoverflow.com/questions/tagged/sql
https://www.nasa.gov/missions
https://www.who.int/health-topics/vaccines
https://www.europarl.europa.eu/news/en
https://www.bundestag.de/dokumente
https://www.service-public.fr/particuliers
https://www.gov.uk/browse/driving
https://www.usgs.gov/programs/earthquake-hazards
https://www.metoffice.gov.uk/weather/forecast
https://www.wetterdienst.de/vorhersage
https://www.louvre.fr/en/visit
https://www.museodelprado.es/coleccion
https://www.britishmuseum.org/collection
https://www.uni-heidelberg.de/de/studium
https://www.ox.ac.uk/admissions
https://www.sorbonne-universite.fr/formations
https://www.uam.es/uam/estudios
https://ocw.mit.edu/courses/mathematics/
https://www.khanacademy.org/math/algebra
https://www.openstreetmap.org/about
https://www.nationalgeographic.com/animals
https://www.rhs.org.uk/plants/articles
https://www.seriouseats.com/bread-recipe
https://www.chefkoch.de/rezepte/kartoffelsuppe
https://www.marmiton.org/recettes/quiche
https://www.recetasgratis.net/receta-de-paella
https://blog.gardeners-notebook.com/2021/05/tomatoes
https://maps.example.com/routes/7
https://forum.bicycle-repair.net/threads/12
http://chess-club-hamburg.de/termine
http://village-church.org/history
https://www.stjohns-school.co.uk/parents/letters
https://www.gymnasium-nord.de/schulleben
https://www.lycee-pasteur.fr/vie-scolaire
https://escuela.example.es/cursos
https://bibliothek.example.de/katalog
https://musee.example.fr/visite
http://harbour.example.net/en/council
http://river-trust.org/projects
http://gardens.example.net/roses
https://astronomy-magazine.com/observing
https://www.history-today.com/archive/railways
https://www.poetry-foundation.org/poems/sonnet
https://www.opera-house.com/season/tickets
http://jazz-festival.net/programme
https://www.filmkritik.de/neu/2023
http://news.example.org/archive/12
https://www.radio-nord.de/programm
https://www.tv-guide.net/tonight
http://railway-timetable.com/stations
https://www.airport-info.org/arrivals
https://hotel-seeblick.de/zimmer
https://www.camping-les-pins.fr/tarifs
https://www.bakery.example.com/menu
https://www.bookshop-central.co.uk/authors
http://furniture-makers.net/oak-tables
https://www.hardware-store.com/tools/hammers
https://www.bank-of-the-north.com/branches
https://www.insurance-advice.org/home
https://www.dentist-main-street.com/appointments
https://www.hospital-st-anna.de/abteilungen
https://www.pharmacy-council.org/standards
https://www.veterinary-clinic.net/dogs
http://law-review.org/volume/12
https://www.statistics-office.net/population
https://data.census.gov/table
https://www.engineering-journal.com/issues/44
https://www.software-manual.net/install/linux
https://mailing-list.kernel-notes.org/2020/03
https://git.small-projects.net/parser/README
https://www.open-source-weekly.com/issue/210
http://weather.example.org/today
http://family-history.org/names/miller
https://www.language-lessons.com/spanish/verbs
https://www.diccionario-libre.es/palabra/casa
https://www.woerterbuch.de/begriff/haus
"""


def rows() -> list[tuple[str, int]]:
    """(url, blocked)."""
    return [(url, 1) for url in UNWANTED.split()] + [(url, 0) for url in WANTED.split()]
