"""Review complaint patterns."""

from __future__ import annotations

from typing import NamedTuple


class ReviewPattern(NamedTuple):
    category: str
    label: str
    pattern: str
    confidence: str
    strong: bool


# --- fixed values: the eleven complaint patterns, order matters ------------------------------
NEGATIVE = (
    r"(no funciona|no carga|mal|fatal|desactualizad[ao]|antigu[ao]|no existe|ca[ií]da|error|confus[ao]|no aparece"
    r"|no est[aá]|horrible|p[eé]sima|imposible)"
)
REVIEW_PATTERNS = [
    ReviewPattern(
        "WRONG_HOURS", "Horario online incorrecto",
        r"(horario (de google |en google |de internet |online |de la web )?(est[aá] |era )?(mal|incorrecto|equivocado"
        r"|desactualizado)|el horario no coincide|pon[ií]a (que )?(estaba )?abierto|(google|maps|internet|la web) (dice"
        r"|pone|dec[ií]a|pon[ií]a|indica(ba)?) (que )?(est[aá]|estaba )?abierto|estaba cerrado (y|pero|aunque) (google"
        r"|internet|la web|maps)|wrong (opening )?hours|hours (are|were) (wrong|incorrect)|listed as open"
        r"|said (it was|they were) open)", "HIGH", True),
    ReviewPattern(
        "WRONG_PHONE", "Teléfono incorrecto",
        r"((el )?tel[eé]fono (que aparece |de google |de la web )?(est[aá] |es )?(mal|incorrecto|equivocado|no existe"
        r"|no funciona|desactualizado)|n[uú]mero (est[aá] |es )?(mal|incorrecto|equivocado|no existe)"
        r"|wrong (phone )?number|number (is|was) (wrong|disconnected))", "HIGH", True),
    ReviewPattern(
        "WRONG_ADDRESS", "Dirección incorrecta",
        r"((la )?direcci[oó]n (est[aá] |es )?(mal|incorrecta|equivocada)|la ubicaci[oó]n (est[aá] |es )?(mal"
        r"|incorrecta)|(google )?maps (te |nos )?(lleva|llev[oó]) a (otro|otra|un sitio)|se han (mudado|trasladado)"
        r"|wrong (address|location))", "HIGH", True),
    ReviewPattern(
        "OUTDATED_INFO", "Información desactualizada",
        r"(informaci[oó]n (desactualizada|antigua|incorrecta|err[oó]nea)|no (est[aá]|tienen) (nada )?actualizad[oa]"
        r"|desactualizad[oa]|outdated|out of date|not up to date)", "MEDIUM", True),
    ReviewPattern(
        "ONLINE_MENU", "Carta/menú online distinto o desactualizado",
        r"((la )?(carta|men[uú]) (online|de (la )?web|de internet|de google)|(la carta|el men[uú]) (no coincide"
        r"|est[aá] desactualizad|era distint|ten[ií]a otros precios)|precios (de la carta |de la web )?(distintos"
        r"|diferentes|no coinciden)|(menu|prices) (online|on the website) (was|were|is|are) (different|wrong"
        r"|outdated))", "MEDIUM", True),
    ReviewPattern(
        "ONLINE_BOOKING", "Dificultad para reservar online",
        r"(no (se )?pued(e|es|en) reservar|reserv(a|ar|as) (online|por internet|por la web)|sistema de reservas"
        r"|no hay (forma|manera) de reservar|no (tienen|hay) reserva online|couldn'?t book|no online booking"
        r"|book(ing)? online)", "MEDIUM", False),
    ReviewPattern(
        "HARD_TO_CONTACT", "Dificultad para contactar",
        r"(no (cogen|coge|contestan|contesta|responden|responde|atienden) (el |al )?(tel[eé]fono|llamadas|mensajes"
        r"|whatsapp|correo|email)|imposible (contactar|hablar con)|dif[ií]cil (contactar|localizar)|nadie (contesta"
        r"|responde)|no answer|hard to reach|couldn'?t reach|never answer)", "HIGH", False),
    ReviewPattern(
        "PHONE_ONLY", "Solo se puede gestionar por teléfono",
        r"(hay que llamar|tienes que llamar|tuve que llamar|solo (por|se puede por) tel[eé]fono|only by phone"
        r"|had to call)", "MEDIUM", False),
    ReviewPattern(
        "WEBSITE", "Comentarios negativos sobre la web",
        r"((la |su |p[aá]gina )web|website|sitio web)[^.!?]{0,40}" + NEGATIVE
        + "|" + NEGATIVE + r"[^.!?]{0,40}((la |su |p[aá]gina )web|website)", "MEDIUM", False),
    ReviewPattern(
        "SERVICES_NOT_FOUND", "Servicios anunciados que ya no se ofrecen",
        r"(ya no (hacen|ofrecen|tienen|venden|sirven)|no (ofrecen|hacen|tienen) lo que (pone|dice|anuncia)"
        r"|anuncian[^.]{0,30}pero no|no longer (offer|serve|sell))", "MEDIUM", False),
    ReviewPattern(
        "CONTRADICTORY_INFO", "Información contradictoria",
        r"(contradictori[ao]|no coincide con lo que (pone|dice)|pone una cosa y|says one thing)", "MEDIUM", False),
]
# --- end of fixed values ---------------------------------------------------------------------
