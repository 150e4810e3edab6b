"""Recommendation catalogue: which findings trigger which offer."""

from __future__ import annotations

from typing import NamedTuple


class RecRule(NamedTuple):
    code: str
    product: str
    title: str
    triggers: list[str]


# --- fixed values: rules in catalogue order --------------------------------------------------
REC_RULES = [
    RecRule("REPLACE_DISCONTINUED_SITE", "Página web corporativa",
            "Sustituir la web discontinuada de Google Business Profile", ["GOOGLE_BUSINESS_SITE_DISCONTINUED"]),
    RecRule("RECOVER_SITE", "Recuperación / nueva web", "Recuperar o rehacer la web caída",
            ["WEBSITE_UNREACHABLE", "WEBSITE_HTTP_ERROR", "DOMAIN_PARKED", "EMPTY_RESPONSE", "WEBSITE_URL_INVALID"]),
    RecRule("MOBILE_FIRST_REDESIGN", "Rediseño responsive", "Rediseño mobile-first",
            ["NO_VIEWPORT", "FIXED_WIDTH_VIEWPORT", "HORIZONTAL_OVERFLOW", "TABLE_LAYOUT", "USES_FLASH"]),
    RecRule("HTTPS_SETUP", "Seguridad (HTTPS)", "Configurar HTTPS correctamente",
            ["NO_HTTPS", "HTTPS_NOT_WORKING", "HTTPS_NOT_ENFORCED", "TLS_CERT_EXPIRED", "TLS_CERT_SELF_SIGNED",
             "TLS_CERT_HOSTNAME_MISMATCH", "TLS_ERROR", "TLS_CHAIN_INCOMPLETE", "TLS_CERT_EXPIRING", "MIXED_CONTENT",
             "HTTP_NOT_REDIRECTED"]),
    RecRule("SPEED_OPTIMIZATION", "Mejora de velocidad", "Optimizar la velocidad de carga",
            ["SLOW_RESPONSE", "HEAVY_IMAGES", "LARGE_HTML", "EXCESSIVE_REDIRECTS"]),
    RecRule("MAINTENANCE_FIXES", "Mantenimiento web", "Reparar enlaces, imágenes y recursos rotos",
            ["BROKEN_INTERNAL_LINKS", "BROKEN_IMAGES", "MISSING_RESOURCES", "CONSOLE_ERRORS"]),
    RecRule("UNIFY_INFORMATION", "Actualización de información",
            "Actualizar información de contacto y unificar fuentes",
            ["PHONE_MISMATCH", "ADDRESS_MISMATCH", "HOURS_MISMATCH", "WEBSITE_HOURS_CONTRADICTORY", "STATUS_CONFLICT",
             "PROVIDER_MISSING_PHONE", "GOOGLE_LISTING_MISSING_WEBSITE", "REVIEW_WRONG_HOURS", "REVIEW_WRONG_PHONE",
             "REVIEW_WRONG_ADDRESS", "REVIEW_OUTDATED_INFO", "REVIEW_CONTRADICTORY_INFO"]),
    RecRule("CONTENT_REFRESH", "Actualización de contenidos", "Actualizar y completar los contenidos",
            ["STALE_COVID_NOTICE", "OLD_DATED_CONTENT", "SITEMAP_STALE", "OLD_COPYRIGHT", "DEAD_EXTERNAL_DOMAINS",
             "PLACEHOLDER_CONTENT", "UNDER_CONSTRUCTION", "THIN_CONTENT", "EMPTY_PAGE", "REVIEW_SERVICES_NOT_FOUND"]),
    RecRule("ONLINE_BOOKING", "Web con reservas", "Evaluar un sistema de reservas/citas online",
            ["NO_ONLINE_BOOKING", "REVIEW_ONLINE_BOOKING", "REVIEW_PHONE_ONLY"]),
    RecRule("DIGITAL_MENU", "Carta/menú digital", "Carta/menú digital legible en móvil",
            ["NO_MENU", "MENU_PDF_ONLY", "REVIEW_ONLINE_MENU"]),
    RecRule("CONTACT_SYSTEM", "Sistema de contacto", "Mejorar el contacto y las llamadas a la acción",
            ["NO_CONTACT_METHOD", "NO_PHONE_ON_SITE", "PHONE_NOT_CLICKABLE", "NO_CTA", "REVIEW_HARD_TO_CONTACT"]),
    RecRule("WHATSAPP_INTEGRATION", "Integración WhatsApp", "Integrar WhatsApp como canal de contacto",
            ["NO_CONTACT_METHOD", "REVIEW_HARD_TO_CONTACT", "REVIEW_PHONE_ONLY"]),
    RecRule("LOCAL_SEO", "SEO local", "SEO local",
            ["MISSING_TITLE", "GENERIC_TITLE", "MISSING_META_DESCRIPTION", "NO_H1", "NO_LOCAL_SCHEMA", "NOINDEX",
             "NO_ADDRESS_OR_MAP", "NO_HOURS_ON_SITE"]),
    RecRule("OWN_DOMAIN", "Dominio propio", "Migrar a un dominio propio", ["FREE_SUBDOMAIN"]),
    RecRule("TECH_UPDATE", "Actualización técnica", "Actualizar la base técnica de la web",
            ["OUTDATED_CMS", "OUTDATED_JQUERY", "DEPRECATED_HTML"]),
    RecRule("ACCESSIBILITY", "Accesibilidad", "Mejoras básicas de accesibilidad",
            ["ACCESSIBILITY_BASIC", "ZOOM_DISABLED", "MISSING_LANG"]),
    RecRule("REAL_PHOTOS", "Galería", "Galería con fotos reales del negocio", ["STOCK_IMAGES"]),
]
HIDDEN_WITHOUT_SITE = ["LOCAL_SEO", "CONTACT_SYSTEM", "DIGITAL_MENU", "ONLINE_BOOKING"]
# offered only when there is no website: (code, product, title, priority, needs)
NEW_SITE_OFFERS = [
    ("CORPORATE_WEBSITE", "Página web corporativa", "Crear web corporativa local", 1, None),
    ("WEBSITE_WITH_BOOKING", "Web con reservas", "Incluir reservas/citas online en la nueva web", 2, "booking"),
    ("WEBSITE_WITH_MENU", "Carta/menú digital", "Incluir carta/menú digital", 2, "menu"),
    ("LANDING_PAGE", "Landing page", "Alternativa económica: landing page", 3, None),
]
THIRD_PARTY_CODES = ["WEBSITE_IS_THIRD_PARTY", "DOMAIN_REDIRECTS_TO_THIRD_PARTY"]
# --- end of fixed values ---------------------------------------------------------------------
