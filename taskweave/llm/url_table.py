"""A small labelled table of invented urls for the filter of ``urls``, and another that is held out to measure it.

Written from general knowledge of what url lists hold: gambling, medicine sold without prescription, adult pages, trackers and banners,
malware and phishing, pirated files, get-rich offers and link farms are to block; all else is not, also where its topic is close (a
pharmacy's opening hours, a poker club's history, a health page). Hosts end in a reserved suffix. No host is in both tables.
"""

from __future__ import annotations

BLOCK = """
royalroulette.test/live jackpotkings.test/slots/egypt www.blackjacktable.test/en/register pokerstake.test/promo?code=99 luckyspin777.test/ slotmania.test/mobile/app.apk sportsbook-odds.test/football/tonight casinograndprix.test/deposit
m.online-roulette.test/de/spielen megajackpot.test/de/bonus wettenjetzt.test/tipps apuestas-casino.test/es/bonos parissportifs.test/fr/cotes scommesse-live.test/it/serie lotto-jackpot.test/ticket/55 bingohall-bonus.test/room/3 highroller-slots.test/vip?ref=12 betting-tips.test/horse/today
viagra-generic.test/order buycialis.test/en/checkout pharmacy-noprescription.test/tramadol onlinemeds-discount.test/shop/12 dietpill-miracle.test/offer steroidshop.test/cart/add?id=4 xanax-overnight.test/buy.html weightloss-pills.test/trial herbal-enhancement.test/men rxdiscount-meds.test/de/potenz
canadian-rxpills.test/ kamagra-kaufen.test/de/bestellen farmacia-sinreceta.test/es/comprar keto-slim-offer.test/lp/2 modafinil-order.test/eu/
hotcams-live.test/room/8821 pornvault.test/video/5531 xxxmovies-hd.test/tag/amateur sexdates-now.test/signup nudecams.test/en/models escortlist.test/city/berlin eroticvideos.test/cat/9 hookup-tonight.test/join?aff=7 pornogratis.test/es/videos/88 milfcams.test/live webcamgirls.test/fr/salon adultdating-xxx.test/start
track.clickserver.test/c?id=889 pixel.adtracker.test/i.gif adclick-redirect.test/go?u=12 banner-exchange.test/728x90.js popunder-network.test/tag.js doubletrack.test/sync?uid=3 affiliate-clicks.test/r/9921 beacon.adserve.test/v1/event promo-banners.test/ad/300x250.html click.trackmail.test/open/77.gif retarget-pixel.test/p?e=view adnetwork-tags.test/vast.xml
paypa1-verify.test/login.php account-security-update.test/signin secure-bank-login.test/verify?id=1 appleid-unlock.test/confirm.html wallet-connect-claim.test/airdrop crypto-giveaway.test/double free-robux-generator.test/get netflix-billing-update.test/pay.php parcel-delivery-fee.test/track?n=22 windows-support-alert.test/call tax-refund-claim.test/form.php login-verify-account.test/update
flashplayer-update.test/setup.exe driver-updater-pro.test/download.exe cleanmypc-now.test/install keygen-cracks.test/photoshop warez-downloads.test/full/crack.zip torrent-movies-hd.test/2160p nulled-scripts.test/theme/77 serialkeys.test/office codec-pack-install.test/get.exe cracked-games.test/iso/19 moviestream-hd.test/watch/4410 mp3-downloads-gratis.test/album/5
makemoneyfast.test/secret earn-from-home.test/500-a-day bitcoin-profit-robot.test/start forex-signals-vip.test/join binary-options-rich.test/guide payday-loans-instant.test/apply fast-cash-loan.test/no-credit-check getrichcrypto.test/webinar passive-income-secret.test/ebook credit-repair-quick.test/now work-at-home-cash.test/signup millionaire-trading-bot.test/demo
backlinks-seller.test/package/3 seo-linkfarm.test/page/991 buy-followers.test/instagram cheaplikes-fast.test/order replica-watches-outlet.test/rolex fake-handbags.test/sale essaywriting-service-buy.test/order fakediploma-shop.test/degree article-spinner-links.test/en/4 guestpost-backlinks.test/list louisreplica-outlet.test/bags discount-sunglasses-outlet.test/sale?x=1 prize-winner-survey.test/claim gift-card-giveaway.test/iphone you-won-reward.test/spin survey-reward-claim.test/step/2
""".split()

ALLOW = """
cityhospital.test/departments/cardiology pharmacy-hours.test/berlin/open pokerclub-history.test/articles/1970 casinobuilding-museum.test/exhibits/art-deco healthadvice.test/en/back-pain medicine-journal.test/vol/12/issue/3 statistics-course.test/lessons/odds-ratio
dailyherald.test/2023/11/04/council-vote www.morningpost.test/world/europe/51882.html abendblatt.test/de/kultur/7731 lemonde-local.test/fr/politique/article-221.html gazzetta-valle.test/it/cronaca/4410/ eldiario-norte.test/es/economia/9023 nieuwsblad.test/nl/sport/331 polskikurier.test/pl/kraj/1208.html radio-nord.test/da/program/22 tidningen.test/sv/kultur/18
www.stateuniversity.test/en/faculty/physics library.college.test/catalog/search?q=plato openlectures.test/course/linear-algebra/7 mathforum.test/thread/20193 chem-lab.test/protocols/titration.html gymnasium-west.test/de/stundenplan lycee-moliere.test/fr/calendrier.html ecole-primaire.test/fr/cantine?semaine=4 scuola-dante.test/it/orari colegio-sur.test/es/matricula phdthesis.test/download/771.pdf
docs.framework.test/v3/api/router.html wiki.editor.test/Main_Page git.project.test/core/commit/88f1 blog.developer.test/posts/memory-safety forum.linuxusers.test/viewtopic.php?t=5521 packages.distro.test/stable/net/curl bugs.tracker-software.test/issue/991 qa.programming.test/questions/1881/sort-a-list mail.lists.test/archive/2019-05/msg0021.html api.weatherdata.test/v1/forecast?lat=52
ministry-transport.test/en/licences taxoffice.test/forms/2024 cityhall.test/minutes/2022/06 parliament.test/debates/day/14 court-records.test/case/88-1120 nationalpark.test/trails/ridge gemeinde-waldau.test/de/termine mairie-rivage.test/fr/etat-civil ayuntamiento.test/es/tramites/12 waterboard.test/nl/dijken police-advice.test/fraud/phishing
grandma-recipes.test/soup/leek bakery-lindt.test/bread?sort=new gardeningclub.test/roses/pruning.html knitting-patterns.test/sweater/112 birdwatch.test/species/heron chesspuzzles.test/daily/889 hikingroutes.test/alps/4 photoclub.test/gallery/2018/autumn cyclingtour.test/stage/9/map woodwork.test/plans/chair fishinglake.test/season aquarium.test/es/entradas
bookshop-corner.test/item/9780 hardware-store.test/screws/m4?page=3 furniture-oak.test/tables/dining flowershop.test/bouquets/66 shoe-repair.test/prices organicmarket.test/de/angebote/81 toyworld.test/puzzles/500-pieces stationery.test/pens/blue opticians.test/termine vintage-records.test/jazz/1959 tailor-suits.test/measure
orchestra.test/season/concert/5 theatre-globe.test/en/tickets/hamlet filmarchive.test/directors/k/12 artgallery.test/exhibition/monet poetry-review.test/issue/8/ocean folkmusic.test/songs/ballad/31 museum-natural.test/fr/horaires/ comics-archive.test/strip/2001-04-02 operahaus.test/de/spielplan/0923.html
railway-timetable.test/line/7 airport-info.test/arrivals ferrylines.test/route/2/fares hotel-seaview.test/rooms/double camping-see.test/de/preise hostel-centro.test/es/reservas/33 busstation.test/stops/118 travelnotes.test/japan/kyoto/day-3 citymap.test/district/old-town mountainhut.test/it/rifugio
farmcoop.test/crops/barley steelworks.test/products/beams engineering-society.test/papers/fluid/204 bank-annualreport.test/2021/summary.pdf insurance-guide.test/terms/excess accountancy.test/blog/vat charity-water.test/projects/well church-stmary.test/services/easter football-club.test/fixtures/2024 rowing.test/results/regatta/19 marathon-city.test/start/list animal-shelter.test/dogs/rex genealogy.test/family/baker/tree astronomy.test/m31?zoom=2 dictionary-online.test/word/serendipity quotes.test/author/seneca/4
""".split()

HELD_OUT_BLOCK = """
roulettepalace.test/en/play slotjackpots.test/bonus/50 vip-blackjack.test/table/3 poker-bonus.test/de/anmelden bettingodds-live.test/tennis apuestas-bonus.test/es/hoy
viagra-order.test/de/shop discount-rxmeds.test/cart cialis-generic.test/buy tramadol-noprescription.test/ dietpills-offer.test/lp/9
xxxcams.test/live/22 pornmovies.test/cat/4 nude-webcam.test/girls sexcams-dating.test/join escort-city.test/fr/paris
adclick-track.test/r?id=2 banner-adserver.test/300x600.js pixel-tracker.test/p.gif affiliate-redirect.test/go/18 popunder-tags.test/x.js
verify-account-login.test/signin.php bank-security-update.test/confirm crypto-airdrop-claim.test/wallet refund-tax-form.test/login.php billing-update-verify.test/pay
keygen-download.test/full.zip cracked-warez.test/iso torrent-hd-movies.test/77 driver-update-install.test/setup.exe
earnmoney-fast.test/join payday-cash-loan.test/apply bitcoin-robot-profit.test/vip forex-profit-signals.test/now
buy-backlinks.test/order/5 replica-outlet.test/watches giveaway-giftcard.test/claim survey-prize-reward.test/win
""".split()

HELD_OUT_ALLOW = """
eveningnews.test/2022/03/11/bridge-opens tagespost.test/de/wirtschaft/4411 lejournal.test/fr/culture/8812.html lanacion-sur.test/es/deportes/2207 corriere-alto.test/it/valle/91
college-north.test/en/physics/lectures archive.library.test/items/221 grundschule-ost.test/de/termine historyforum.test/thread/881 biology-lab.test/cells/mitosis.html
docs.database.test/v9/indexes.html wiki.compiler.test/Optimizations forum.photography.test/viewtopic.php?t=77 git.library-core.test/commit/aa81 questions.statistics.test/8821/variance
ministry-health.test/en/vaccines townhall.test/minutes/2019 mairie-lac.test/fr/horaires nationalmuseum.test/en/tickets police-report.test/statistics/2020
soup-recipes.test/lentil rosegarden.test/pruning/3 alpinehikes.test/route/12/map chessclub.test/games/1972 heron-watch.test/lake/spring
bookstore-oak.test/item/331 tables-chairs.test/oak?page=2 flower-market.test/tulips opticians-west.test/en/prices jazz-records.test/1957/monk
concerthall.test/season/2023 filmfestival.test/en/programme/9 poetry-archive.test/poem/ode busroutes.test/line/44 seaview-camping.test/de/2024
cropscience.test/papers/12 water-charity.test/wells/88 rowingclub.test/results familytree.test/miller/1850 dictionary-latin.test/word/amicus
""".split()

#: (url, 1 for one to block).
LABELLED = tuple((f"http://{u}", 1) for u in BLOCK) + tuple((f"http://{u}", 0) for u in ALLOW)
HELD_OUT = tuple((f"http://{u}", 1) for u in HELD_OUT_BLOCK) + tuple((f"http://{u}", 0) for u in HELD_OUT_ALLOW)
