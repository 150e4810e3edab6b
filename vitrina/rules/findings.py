"""Finding codes with their category and display title (``{}`` marks the measured value)."""

from __future__ import annotations

# --- fixed values: code -> (category, title) -------------------------------------------------
FINDINGS = {
    "WEBSITE_URL_INVALID": ("AVAILABILITY", "La URL de la web no es válida"),
    "WEBSITE_IS_THIRD_PARTY": ("PRESENCE", 'La "web" publicada es un perfil de {}'),
    "GOOGLE_BUSINESS_SITE_DISCONTINUED": (
        "AVAILABILITY", "Web creada con Google Business Profile (servicio discontinuado)"),
    "FREE_SUBDOMAIN": ("PRESENCE", "La web usa un subdominio gratuito (sin dominio propio)"),
    "WEBSITE_UNREACHABLE": ("AVAILABILITY", "La web no está disponible"),
    "WEBSITE_HTTP_ERROR": ("AVAILABILITY", "La web devuelve un error"),
    "EMPTY_RESPONSE": ("AVAILABILITY", "La web responde vacía"),
    "HTTPS_NOT_WORKING": ("SECURITY", "HTTPS no funciona; la web solo responde por HTTP"),
    "TLS_CHAIN_INCOMPLETE": ("SECURITY", "Cadena de certificados HTTPS incompleta"),
    "TLS_CERT_EXPIRED": ("SECURITY", "Certificado HTTPS caducado"),
    "TLS_CERT_SELF_SIGNED": ("SECURITY", "Certificado HTTPS autofirmado"),
    "TLS_CERT_HOSTNAME_MISMATCH": ("SECURITY", "El certificado HTTPS no corresponde al dominio"),
    "TLS_ERROR": ("SECURITY", "Error en la conexión segura (HTTPS)"),
    "DOMAIN_REDIRECTS_TO_THIRD_PARTY": ("PRESENCE", "El dominio redirige a {}"),
    "DOMAIN_PARKED": ("AVAILABILITY", "Dominio aparcado o en venta"),
    "DOMAIN_PARKED_TEXT": ("AVAILABILITY", "Página de dominio aparcado, cuenta suspendida o servidor por defecto"),
    "REDIRECTS_TO_OTHER_DOMAIN": ("PRESENCE", "La web redirige a otro dominio"),
    "ROBOTS_BLOCKS_ANALYSIS": ("AVAILABILITY", "El sitio no permite el análisis automatizado (robots.txt)"),
    "JS_APP_BROKEN": ("AVAILABILITY", "La web no puede cargar: sus scripts principales devuelven error"),
    "CONSOLE_ERRORS": ("UX", "Errores de JavaScript en consola"),
    "UNDER_CONSTRUCTION": ("CONTENT", "Web en construcción o en mantenimiento"),
    "PLACEHOLDER_CONTENT": ("CONTENT", "Contenido de plantilla o de ejemplo sin sustituir"),
    "HTTPS_NOT_ENFORCED": ("SECURITY", "La web no fuerza HTTPS"),
    "NO_HTTPS": ("SECURITY", "La web no tiene HTTPS"),
    "HTTP_NOT_REDIRECTED": ("SECURITY", "La versión HTTP no redirige a HTTPS"),
    "TLS_CERT_EXPIRING": ("SECURITY", "El certificado HTTPS caduca en {} días"),
    "EXCESSIVE_REDIRECTS": ("PERFORMANCE", "Demasiadas redirecciones"),
    "SLOW_RESPONSE_HIGH": ("PERFORMANCE", "La web tarda mucho en responder"),
    "SLOW_RESPONSE": ("PERFORMANCE", "La web responde lenta"),
    "LARGE_HTML": ("PERFORMANCE", "HTML muy pesado"),
    "HEAVY_IMAGES": ("PERFORMANCE", "Imágenes muy pesadas"),
    "BROKEN_INTERNAL_LINKS": ("UX", "{} enlace(s) interno(s) roto(s)"),
    "BROKEN_IMAGES": ("UX", "{} imagen(es) rota(s)"),
    "MISSING_RESOURCES": ("UX", "Recursos (CSS/JS) que no cargan"),
    "DEAD_EXTERNAL_DOMAINS": ("FRESHNESS", "Enlaces a dominios que ya no existen"),
    "NO_FAVICON": ("UX", "Sin favicon"),
    "MISSING_TITLE": ("SEO", "La portada no tiene título (<title>)"),
    "GENERIC_TITLE": ("SEO", "Título de la portada genérico o muy corto"),
    "LONG_TITLE": ("SEO", "Título demasiado largo"),
    "MISSING_META_DESCRIPTION": ("SEO", "Sin meta descripción"),
    "NO_H1": ("SEO", "La portada no tiene encabezado principal (H1)"),
    "MULTIPLE_H1": ("SEO", "La portada tiene {} encabezados H1"),
    "MISSING_LANG": ("ACCESSIBILITY", "No se declara el idioma de la página"),
    "NOINDEX": ("SEO", "La portada indica a Google que no la indexe (noindex)"),
    "NO_LOCAL_SCHEMA": ("SEO", "Sin datos estructurados de negocio local (schema.org)"),
    "NO_VIEWPORT": ("MOBILE", "Sin etiqueta viewport: probablemente no se adapta al móvil"),
    "FIXED_WIDTH_VIEWPORT": ("MOBILE", "Viewport de ancho fijo: diseño no responsive"),
    "ZOOM_DISABLED": ("ACCESSIBILITY", "La web impide hacer zoom en móvil"),
    "HORIZONTAL_OVERFLOW": ("MOBILE", "La página se desborda horizontalmente en móvil"),
    "TABLE_LAYOUT": ("MOBILE", "Maquetación basada en tablas (técnica antigua)"),
    "USES_FLASH": ("MOBILE", "La web usa Flash"),
    "DEPRECATED_HTML": ("UX", "HTML obsoleto"),
    "ACCESSIBILITY_BASIC": ("ACCESSIBILITY", "Problemas básicos de accesibilidad"),
    "OUTDATED_CMS": ("SECURITY", "WordPress antiguo (versión {})"),
    "OUTDATED_CMS_JOOMLA": ("SECURITY", "Joomla muy antiguo"),
    "OUTDATED_JQUERY": ("SECURITY", "jQuery antiguo ({})"),
    "MIXED_CONTENT": ("SECURITY", "Contenido mixto (recursos HTTP en página HTTPS)"),
    "EMPTY_PAGE": ("CONTENT", "La portada casi no tiene contenido"),
    "THIN_CONTENT": ("CONTENT", "Muy poco contenido"),
    "NO_CONTACT_METHOD": ("CONTACT", "No se encuentra ninguna forma de contacto en la web"),
    "NO_PHONE_ON_SITE": ("CONTACT", "La web no muestra teléfono"),
    "PHONE_NOT_CLICKABLE": ("CONTACT", "El teléfono no es clicable"),
    "NO_CTA": ("UX", "No se detecta una llamada a la acción clara"),
    "NO_ADDRESS_OR_MAP": ("CONTENT", "La web no muestra dirección ni mapa"),
    "NO_HOURS_ON_SITE": ("CONTENT", "No se encuentran horarios en la web"),
    "NO_ONLINE_BOOKING": ("UX", "No se detecta reserva o cita online"),
    "NO_MENU": ("CONTENT", "No se encuentra la carta/menú en la web"),
    "MENU_PDF_ONLY": ("UX", "La carta solo está en PDF"),
    "NO_SOCIAL_LINKS": ("PRESENCE", "La web no enlaza redes sociales"),
    "LIMITED_NAVIGATION": ("UX", "Navegación muy limitada"),
    "STOCK_IMAGES": ("CONTENT", "Uso abundante de imágenes de stock"),
    "PHONE_MISMATCH": ("CONSISTENCY", "El teléfono de {} no aparece en la web"),
    "PROVIDER_MISSING_PHONE": ("CONSISTENCY", "La ficha de {} no tiene teléfono, pero la web sí"),
    "ADDRESS_MISMATCH": ("CONSISTENCY", "Posible discrepancia de dirección entre la ficha y la web"),
    "WEBSITE_HOURS_CONTRADICTORY": ("CONSISTENCY", "La web declara horarios contradictorios"),
    "HOURS_MISMATCH": ("CONSISTENCY", "El horario de la web no coincide con el de {}"),
    "STATUS_CONFLICT": ("CONSISTENCY", "La web anuncia un cierre temporal que la ficha no refleja"),
    "STALE_COVID_NOTICE": ("FRESHNESS", "Posible aviso de COVID-19 sin retirar"),
    "OLD_DATED_CONTENT": ("FRESHNESS", "Posibles eventos o promociones de años anteriores"),
    "OLD_COPYRIGHT": ("FRESHNESS", "Año de copyright antiguo ({})"),
    "SITEMAP_STALE": ("FRESHNESS", "El sitemap indica que la web no se actualiza desde hace más de 2 años"),
    "GOOGLE_LISTING_MISSING_WEBSITE": ("CONSISTENCY", "La ficha de {} no enlaza la web del negocio"),
    "NO_WEBSITE": ("PRESENCE", "No se ha encontrado web oficial verificable"),
    "PROBABLE_PUBLIC_ENTITY": ("PRESENCE", "Posible entidad pública"),
    "BUSINESS_CLOSED_PERMANENTLY": ("PRESENCE", "Negocio cerrado permanentemente según el proveedor"),
    "BUSINESS_CLOSED_TEMPORARILY": ("PRESENCE", "Negocio cerrado temporalmente según el proveedor"),
}
# --- end of fixed values ---------------------------------------------------------------------
