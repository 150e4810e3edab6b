"""Text patterns of the audit rules, in the portable notation of ``rules.regex``."""

from __future__ import annotations

# --- fixed values: words and patterns the results depend on ----------------------------------
NAME_STOPWORDS = [
    "de", "la", "el", "los", "las", "y", "e", "en", "del", "al", "a", "the", "and", "of", "sl", "s", "l", "sa", "slu",
    "bar", "restaurante", "cafe", "cafeteria", "clinica", "centro", "taller", "tienda", "peluqueria",
]
STREET_TYPE_WORDS = ["calle", "avenida", "plaza", "paseo", "carretera"]

PUBLIC_ENTITY = (
    r"^(centro de salud|consultorio( local| auxiliar)?|hospital (universitario|general|provincial|comarcal)"
    r"|ambulatorio|centro de atenci[oó]n primaria|cap |ayuntamiento|excmo\.? ayuntamiento|junta de|diputaci[oó]n"
    r"|delegaci[oó]n (del gobierno|provincial)|ceip|cp |ies |colegio p[uú]blico|instituto de educaci[oó]n secundaria"
    r"|biblioteca (municipal|p[uú]blica)|polideportivo municipal|comisar[ií]a|guardia civil"
    r"|polic[ií]a (local|nacional)|juzgado|registro civil|oficina de correos|correos$)"
)
PLACEHOLDER = (
    r"(lorem ipsum|dolor sit amet|hello world!|¡hola,? mundo!|just another wordpress site"
    r"|otro sitio realizado con wordpress|sample page|p[aá]gina de ejemplo|this is an example page"
    r"|welcome to wordpress|your site title|add your (text|content) here|insert (your )?text here|texto de ejemplo)"
)
UNDER_CONSTRUCTION = (
    r"(under construction|en construcci[oó]n|coming soon|pr[oó]ximamente|website coming soon"
    r"|estamos trabajando en (nuestra|la) (nueva )?web|sitio en mantenimiento|maintenance mode|modo mantenimiento)"
)
PARKED = (
    r"(domain (is )?for sale|buy this domain|este dominio (est[aá] )?(en venta|a la venta)|dominio en venta"
    r"|this domain (has expired|is parked|may be for sale)|dominio (caducado|expirado)|parked (free|domain)"
    r"|sedoparking|domain parking|hugedomains|afternic|dan\.com|account (has been )?suspended"
    r"|cuenta (ha sido )?suspendida|this account has been suspended|default web site page|welcome to nginx!"
    r"|apache2? (ubuntu|debian)? ?default page|it works!|iis windows server|index of \/|site not found"
    r"|no website configured at this address)"
)
PARKED_MAX_WORDS, UNDER_CONSTRUCTION_MAX_WORDS = 400, 250

STALE_COVID = (
    r"(covid(-?19)?|coronavirus|estado de alarma|desescalada|medidas sanitarias|mascarilla obligatoria"
    r"|aforo (reducido|limitado)|confinamiento|pandemia)"
)
TEMPORARILY_CLOSED = r"(cerrado temporalmente|temporalmente cerrado|temporarily closed)"
EVENT_WORDS = (
    r"(navidad(es)?|nochevieja|nochebuena|fin de a[nñ]o|cotill[oó]n|san valent[ií]n|semana santa|feria|carnaval(es)?"
    r"|halloween|black friday|rebajas|temporada|campa[nñ]a|promoci[oó]n|oferta|evento|men[uú] especial"
    r"|horario de (verano|invierno)|vacaciones|cerrado por vacaciones|christmas|new year'?s|valentine'?s|summer"
    r"|season|curso)"
)
SINCE_WORDS = r"(©|copyright|desde|since|fundad[oa]|founded|established|est\.)"
COPYRIGHT = (
    r"(?:©|&copy;|copyright|\(c\))\s*(?:[^0-9]{0,40})?((?:19|20)\d{2})(?:\s*[-–/]\s*((?:19|20)\d{2}))?"
)
HOURS_TEXT = (
    r"\b(lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bados?|domingos?|festivos|l-v|lun|mar|mi[eé]|jue|vie|s[aá]b|dom"
    r"|mon(day)?|tue(sday)?|wed(nesday)?|thu(rsday)?|fri(day)?|sat(urday)?|sun(day)?)\b[^.\n]{0,40}?"
    r"\b([01]?\d|2[0-3])[:.h]([0-5]\d)?\s*(h|hrs|am|pm)?\s*(-|–|a|to|hasta)\s*([01]?\d|2[0-3])[:.h]?([0-5]\d)?"
)
ADDRESS_TEXT = (
    r"\b(c\/|calle|avda\.?|avenida|plaza|pza\.?|paseo|p\.º|ctra\.?|carretera|camino|ronda|glorieta|pol[ií]gono"
    r"|urbanizaci[oó]n|street|st\.|avenue|road)\s+[^\n,;|]{2,60}"
)
POSTAL_CODE = r"\b((?:0[1-9]|[1-4]\d|5[0-2])\d{3})\b"
POSTAL_CONTEXT = (
    r"(c\/|calle|avda|avenida|plaza|paseo|ctra|c\.p\.|cp|código postal|codigo postal"
    r"|\b(sevilla|madrid|barcelona|valencia|m[aá]laga|spain|españa)\b)"
)
EMAIL = r"(?:^|[^\p{L}\p{N}._%+-])([\p{L}\p{N}._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,24})"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"
EMAIL_BLOCKED = [
    r"\.(png|jpe?g|gif|webp|svg|css|js)$",
    r"@(example|domain|dominio|tudominio|yourdomain|email|correo|sentry|sentry-next|wixpress|mysite)\.",
    r"^(nombre|name|usuario|user|test|tuemail|your-?email|email|correo)@",
    r"@\d+x\.",
]
CTA = (
    r"\b(reserv(ar|a|as|e)|haz tu reserva|pide|pedir|pedido|llam(a|ar|anos)|cont[aá]cta(nos|r)?|contactar|presupuesto"
    r"|cita|compra(r)?|comprar|whatsapp|inscr[ií]bete|ap[uú]ntate|book|call|contact us|order|buy|get a quote|sign up"
    r"|appointment)\b"
)
BOOKING_TEXT = (
    r"\b(reserv(ar|a|as)(\s+(online|mesa|ahora|ya))?|haz tu reserva|book( a table| now| online)"
    r"|(pide|pedir|solicita|solicitar|reserva|reservar|coge|coger|concierta|concertar)\s+(tu\s+|una\s+|su\s+)?cita"
    r"|cita (previa|online)|reservation|appointment)\b"
)
RIGHTS_RESERVED = r"derechos reservados"
BOOKING_PATH = (
    r"\/(cita|citas|pedir-cita|cita-previa|cita-[a-z-]+|reserva|reservas|reservar|booking|book|appointment)(\/|$|\.)"
)
MENU_TEXT = r"\b(carta|nuestra carta|men[uú]( del d[ií]a| degustaci[oó]n)?|food menu|drinks menu)\b"
MENU_PATH = r"\/(carta|menu|menus|la-carta|nuestra-carta)(\/|\.|$)"
PDF_LINK = r"\.pdf($|\?)"
CONTACT_LINK = (
    r"(contact|contacto|contacta|cont[aá]ctanos|donde-estamos|d[oó]nde estamos|localizaci[oó]n|ubicaci[oó]n"
    r"|como-llegar|c[oó]mo llegar)"
)
MAP_FRAME = r"google\.[a-z.]+\/maps|maps\.google|openstreetmap\.org|maps\.apple|bing\.com\/maps"
MAP_LINK = r"google\.[a-z.]+\/maps|maps\.google|goo\.gl\/maps|maps\.app\.goo\.gl|g\.page\/"
STOCK_IMAGE = (
    r"(shutterstock|istockphoto|gettyimages|depositphotos|dreamstime|123rf|pexels|unsplash|freepik|pixabay"
    r"|stock-photo|adobestock)"
)
LOCAL_SCHEMA = (
    r"LocalBusiness|Restaurant|Store|Organization|Dentist|Physician|Hotel|AutoRepair|BeautySalon|HairSalon"
    r"|LegalService|MedicalBusiness|HealthClub|FoodEstablishment|ProfessionalService"
)
GENERIC_TITLE = r"^(home|inicio|index|untitled|sin t[ií]tulo|mi sitio|my site|welcome|bienvenid[oa]s?)$"
FIXED_VIEWPORT = r"width\s*=\s*\d{3,4}"
NO_ZOOM = r"user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*1(\.0)?\b"
JQUERY = r"jquery[.-]?(\d+\.\d+(\.\d+)?)?(\.min)?\.js(\?ver=(\d+\.\d+(\.\d+)?))?"
CHALLENGE = r"just a moment|cf-chl|attention required|captcha|access denied"
DEPRECATED_TAGS = ["font", "center", "marquee", "blink", "frameset", "frame", "applet"]
BINARY_PATH = r"\.(pdf|jpe?g|png|gif|zip|docx?|xlsx?|mp4|mp3)$"
FRONTIER_KINDS = [
    ("menu", r"(carta|menu)"),
    ("booking", r"(reserv|booking|cita)"),
    ("services", r"(servicio|service|tratamiento|especialidad|tarifa|precio|pricing)"),
    ("about", r"(nosotros|quienes|about|empresa|historia|equipo)"),
    ("hours", r"(horario|hours)"),
]
TLS_CASES = [
    (r"UNABLE_TO_VERIFY_LEAF_SIGNATURE|UNABLE_TO_GET_ISSUER_CERT", "TLS_CHAIN_INCOMPLETE", "MEDIUM"),
    (r"EXPIRED", "TLS_CERT_EXPIRED", "CRITICAL"),
    (r"SELF_SIGNED", "TLS_CERT_SELF_SIGNED", "CRITICAL"),
    (r"ALTNAME|HOSTNAME", "TLS_CERT_HOSTNAME_MISMATCH", "CRITICAL"),
]
UNREACHABLE_REASON = {
    "DNS_NOT_FOUND": "El dominio no existe o no resuelve (DNS): posible dominio caducado",
    "CONNECTION_REFUSED": "El servidor rechaza la conexión",
    "TIMEOUT": "La web no responde (tiempo de espera agotado en varios intentos)",
    "HOST_UNREACHABLE": "El servidor es inalcanzable",
    "CONNECTION_RESET": "El servidor corta la conexión",
    "TOO_MANY_REDIRECTS": "La web entra en un bucle de redirecciones",
    "TLS_ERROR": "No se puede establecer conexión segura",
    "PROTOCOL_ERROR": "El servidor devuelve una respuesta HTTP inválida",
}
SECRET_KEY_NAME = (
    r"(api[-_]?key|token|secret|password|passwd|authorization|cookie|x-goog-api-key|x-subscription-token|p256dh|auth)$"
)
# (pattern, replacement, ignore case)
SECRETS_IN_TEXT = [
    (r"([?&](?:key|api_key|apikey|token|access_token)=)[^&\s]+", True),
    (r"(postgres(?:ql)?:\/\/[^:\s]+:)[^@\s]+(@)", True),
    (r"(Bearer\s+)[A-Za-z0-9._~+/-]+=*", False),
]
# --- end of fixed values ---------------------------------------------------------------------

# ASCII characters (in either case) that a match of the pattern can begin with; ``rules.regex.java`` tries no other ASCII place.
FIRST = {
    HOURS_TEXT: "lmjvsdftw", ADDRESS_TEXT: "caprgus", POSTAL_CODE: "012345", POSTAL_CONTEXT: "capsmbve", PARKED: "dbetpshacwin",
    UNDER_CONSTRUCTION: "uecpwsm", PLACEHOLDER: "ldhjosptwyai", STALE_COVID: "cedmap", TEMPORARILY_CLOSED: "ct", COPYRIGHT: "&c(",
    CHALLENGE: "jca",
}
