"""Third-party hosts: what does and does not count as a business's own website."""

from __future__ import annotations

# --- fixed values: (kind, label, domains), first rule wins -----------------------------------
PLATFORM_RULES = [
    ("SOCIAL", "Facebook", ["facebook.com", "fb.com", "fb.me"]),
    ("SOCIAL", "Instagram", ["instagram.com", "instagr.am"]),
    ("SOCIAL", "TikTok", ["tiktok.com"]),
    ("SOCIAL", "X/Twitter", ["twitter.com", "x.com"]),
    ("SOCIAL", "LinkedIn", ["linkedin.com"]),
    ("SOCIAL", "YouTube", ["youtube.com", "youtu.be"]),
    ("SOCIAL", "Pinterest", ["pinterest.com", "pinterest.es"]),
    ("MESSAGING", "WhatsApp", ["wa.me", "whatsapp.com", "wa.link"]),
    ("MESSAGING", "Telegram", ["t.me", "telegram.me"]),
    ("LINK_AGGREGATOR", "Linktree",
     ["linktr.ee", "linktree.com", "beacons.ai", "lnk.bio", "bio.link", "taplink.cc", "campsite.bio"]),
    ("MAPS", "Google Maps", ["maps.google.com", "goo.gl", "maps.app.goo.gl", "g.page", "google.com"]),
    ("DIRECTORY", "TripAdvisor", ["tripadvisor.com", "tripadvisor.es", "tripadvisor.co.uk", "tripadvisor.com.mx"]),
    ("DIRECTORY", "Yelp", ["yelp.com", "yelp.es"]),
    ("DIRECTORY", "Páginas Amarillas", ["paginasamarillas.es"]),
    ("DIRECTORY", "Restaurant Guru", ["restaurantguru.com", "restaurantguru.es"]),
    ("DIRECTORY", "Doctoralia", ["doctoralia.es", "doctoralia.com", "doctoralia.com.mx"]),
    ("DIRECTORY", "Cylex", ["cylex.es", "cylex-espana.es"]),
    ("DIRECTORY", "Foursquare", ["foursquare.com"]),
    ("DIRECTORY", "Habitissimo", ["habitissimo.es"]),
    ("DIRECTORY", "QDQ", ["qdq.com"]),
    ("DIRECTORY", "Infoisinfo", ["infoisinfo.es"]),
    ("DELIVERY", "Just Eat", ["just-eat.es", "just-eat.com", "just-eat.co.uk"]),
    ("DELIVERY", "Glovo", ["glovoapp.com"]),
    ("DELIVERY", "Uber Eats", ["ubereats.com"]),
    ("DELIVERY", "Deliveroo", ["deliveroo.es", "deliveroo.co.uk", "deliveroo.com"]),
    ("BOOKING_PLATFORM", "TheFork", ["thefork.es", "thefork.com", "eltenedor.es", "lafourchette.com"]),
    ("BOOKING_PLATFORM", "Booking.com", ["booking.com"]),
    ("BOOKING_PLATFORM", "Airbnb", ["airbnb.es", "airbnb.com"]),
    ("BOOKING_PLATFORM", "Treatwell", ["treatwell.es", "treatwell.com", "treatwell.co.uk"]),
    ("BOOKING_PLATFORM", "Booksy", ["booksy.com"]),
    ("BOOKING_PLATFORM", "Fresha", ["fresha.com"]),
    ("BOOKING_PLATFORM", "CoverManager", ["covermanager.com"]),
    ("BOOKING_PLATFORM", "OpenTable", ["opentable.com", "opentable.es"]),
    ("BOOKING_PLATFORM", "Calendly", ["calendly.com"]),
    ("DISCONTINUED_BUILDER", "Google Business Site (discontinuado)", ["business.site", "negocio.site"]),
    ("FREE_SUBDOMAIN_BUILDER", "Subdominio gratuito",
     ["wixsite.com", "wordpress.com", "blogspot.com", "blogspot.es", "webnode.es", "webnode.com", "webnode.page",
      "jimdosite.com", "jimdofree.com", "sites.google.com", "carrd.co", "godaddysites.com", "square.site",
      "ueniweb.com", "weebly.com", "site123.me", "strikingly.com", "mystrikingly.com", "wix.com", "webflow.io",
      "framer.website", "github.io", "netlify.app", "vercel.app", "odoo.com", "hostingersite.com",
      "myshopify.com"]),
]
OWN_SITE_KINDS = ["FREE_SUBDOMAIN_BUILDER", "DISCONTINUED_BUILDER"]
MAPS_ONLY_DOMAIN = "google.com"  # counts only for paths under /maps

TWO_LEVEL_SUFFIXES = [
    "com.es", "org.es", "nom.es", "gob.es", "edu.es", "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "com.mx",
    "org.mx", "gob.mx", "com.ar", "org.ar", "com.co", "com.pe", "com.br", "com.cl", "com.uy", "com.ve", "com.ec",
    "com.au", "net.au", "co.nz", "co.za", "com.pt",
]
PARKING_HOSTS = [
    "sedo.com", "dan.com", "afternic.com", "hugedomains.com", "bodis.com", "parkingcrew.net", "above.com",
    "undeveloped.com",
]
SEARCH_IGNORE_DOMAINS = [
    "google.com", "wikipedia.org", "paginasamarillas.es", "tripadvisor.es", "tripadvisor.com", "yelp.es", "yelp.com",
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "twitter.com", "x.com",
    "infoisinfo.es", "cylex.es", "einforma.com", "axesor.es", "empresite.eleconomista.es", "eleconomista.es",
    "infoempresa.com", "iberinform.es", "guiaempresa.universia.es", "11870.com", "qdq.com", "restaurantguru.com",
    "thefork.es", "eltenedor.es", "justeat.es", "just-eat.es", "glovoapp.com", "ubereats.com", "booking.com",
    "doctoralia.es", "topdoctors.es", "habitissimo.es", "milanuncios.com", "wallapop.com", "amazon.es", "abc.es",
    "elmundo.es", "elpais.com", "diariodesevilla.es",
]
BOOKING_HOSTS = [
    "thefork", "eltenedor", "covermanager", "opentable", "booksy", "treatwell", "fresha", "calendly", "simplybook",
    "bookitit", "reservio", "doctoralia", "setmore", "acuityscheduling", "timify", "zappyrent", "restoo", "tock",
    "resengo", "booking.com", "bookeo", "square.site/book", "koibox", "gestiona", "mindbodyonline", "glofox",
    "trainingym",
]
CONTACT_TYPE_BY_LABEL = {
    "Instagram": "INSTAGRAM", "Facebook": "FACEBOOK", "TikTok": "TIKTOK", "LinkedIn": "LINKEDIN",
    "X/Twitter": "X", "YouTube": "YOUTUBE",
}
# --- end of fixed values ---------------------------------------------------------------------


def flat_platforms() -> list[tuple[int, str, str, str]]:
    """(rule order, domain, kind, label), one row per domain."""
    return [(i, d, kind, label) for i, (kind, label, domains) in enumerate(PLATFORM_RULES) for d in domains]
