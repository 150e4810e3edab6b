"""Fixed vocabularies: enum orders, category groups and display labels."""

from __future__ import annotations

# --- fixed values: vocabularies in their canonical order -------------------------------------
WEBSITE_STATUSES = ["SIN_WEB", "WEB_CAIDA", "WEB_FUNCIONAL_CON_PROBLEMAS", "WEB_ACEPTABLE", "WEB_NO_VERIFICABLE"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
LEVELS = ["HIGH", "MEDIUM", "LOW", "INSUFFICIENT_EVIDENCE"]
LEAD_STATUSES = ["NEW", "TO_CONTACT", "CONTACTED", "INTERESTED", "PROPOSAL_SENT", "WON", "LOST", "DISCARDED"]
CLOSED_LEADS = ["WON", "LOST", "DISCARDED"]

TECHNICAL_CATEGORIES = ["AVAILABILITY", "SECURITY", "PERFORMANCE", "SEO", "MOBILE", "ACCESSIBILITY", "UX"]
CONTENT_CATEGORIES = ["CONTENT", "CONTACT"]
CONSISTENCY_CATEGORIES = ["FRESHNESS", "CONSISTENCY", "REVIEWS"]

CONTACT_PRIORITY = [
    "PHONE", "EMAIL", "CONTACT_FORM", "WHATSAPP", "CONTACT_PAGE", "INSTAGRAM", "FACEBOOK",
    "BOOKING_PAGE", "TIKTOK", "LINKEDIN", "X", "YOUTUBE", "OTHER",
]
SOCIAL_TYPES = ["INSTAGRAM", "FACEBOOK", "TIKTOK", "LINKEDIN", "X", "YOUTUBE"]

WEBSITE_STATUS_LABEL = {
    "SIN_WEB": "Sin web",
    "WEB_CAIDA": "Web caída",
    "WEB_FUNCIONAL_CON_PROBLEMAS": "Web con problemas",
    "WEB_ACEPTABLE": "Web aceptable",
    "WEB_NO_VERIFICABLE": "No verificable",
}
LEVEL_LABEL = {
    "HIGH": "Alta oportunidad",
    "MEDIUM": "Oportunidad media",
    "LOW": "Oportunidad baja",
    "INSUFFICIENT_EVIDENCE": "Evidencia insuficiente",
}
SEVERITY_LABEL = {"CRITICAL": "Crítico", "HIGH": "Alto", "MEDIUM": "Medio", "LOW": "Bajo", "INFO": "Info"}
LEAD_STATUS_LABEL = {
    "NEW": "Nuevo",
    "TO_CONTACT": "Por contactar",
    "CONTACTED": "Contactado",
    "INTERESTED": "Interesado",
    "PROPOSAL_SENT": "Propuesta enviada",
    "WON": "Cliente",
    "LOST": "Perdido",
    "DISCARDED": "Descartado",
}
DAY_LABEL = ["Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado"]

PROVIDERS = [
    ("google_places", "Google Places API (New)", "PLACES", "Proveedor principal. Place ID como identificador estable."),
    ("osm", "OpenStreetMap (Overpass + Nominatim)", "PLACES", "Gratuito. Sin reseñas; campo web incompleto."),
    ("brave", "Brave Search API", "SEARCH", "Opcional: búsqueda de web oficial no enlazada."),
    ("website", "Web oficial del negocio", "WEBSITE", "Crawler propio con política anti-SSRF."),
]
PROVIDER_LABEL = {"google_places": "Google", "osm": "OpenStreetMap"}
WEBSITE_FIELD_RELIABILITY = {"google_places": 0.85, "osm": 0.45}
# --- end of fixed values ---------------------------------------------------------------------

SEVERITY_RANK = {s: i for i, s in enumerate(SEVERITIES)}
