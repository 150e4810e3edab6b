"""Business category catalogue."""

from __future__ import annotations

from typing import NamedTuple


class Category(NamedTuple):
    key: str
    label_es: str
    label_en: str
    query_es: str
    query_en: str
    place_types: list[str]
    tag_filters: list[tuple[str, str]]  # (tag key, anchored value pattern)
    needs_booking: bool
    needs_menu: bool


# --- fixed values: the twelve catalogue entries, catalogue order matters ---------------------
CATEGORIES = [
    Category("restaurantes", "Restaurantes", "Restaurants", "restaurantes", "restaurants",
             ["restaurant", "meal_takeaway", "fast_food_restaurant"],
             [("amenity", "^(restaurant|fast_food)$")], True, True),
    Category("bares_cafeterias", "Bares y cafeterías", "Bars & cafés", "bares y cafeterías", "bars and cafes",
             ["bar", "cafe", "coffee_shop", "pub"],
             [("amenity", "^(bar|cafe|pub)$")], False, True),
    Category("peluquerias_estetica", "Peluquerías y estética", "Hair & beauty",
             "peluquerías y centros de estética", "hair salons and beauty salons",
             ["hair_salon", "beauty_salon", "barber_shop", "nail_salon", "hair_care"],
             [("shop", "^(hairdresser|beauty)$")], True, False),
    Category("gimnasios", "Gimnasios", "Gyms", "gimnasios", "gyms",
             ["gym", "fitness_center", "yoga_studio"],
             [("leisure", "^(fitness_centre|sports_centre)$")], True, False),
    Category("clinicas", "Clínicas y salud", "Clinics & health",
             "clínicas dentales fisioterapia", "dental clinics physiotherapy",
             ["dentist", "dental_clinic", "doctor", "physiotherapist", "medical_clinic", "chiropractor"],
             [("amenity", "^(dentist|clinic|doctors)$"), ("healthcare", "^(physiotherapist|dentist|clinic)$")],
             True, False),
    Category("talleres", "Talleres", "Car repair", "talleres mecánicos", "car repair shops",
             ["car_repair", "car_wash", "auto_parts_store"],
             [("shop", "^(car_repair|tyres|car_parts)$")], True, False),
    Category("tiendas", "Tiendas", "Shops", "tiendas", "shops",
             ["store", "clothing_store", "shoe_store", "gift_shop", "furniture_store", "jewelry_store", "florist"],
             [("shop", "^(clothes|shoes|gift|furniture|jewelry|florist|boutique|books|toys|sports|optician"
                       "|bakery|butcher|deli)$")], False, False),
    Category("abogados_asesorias", "Abogados y asesorías", "Lawyers & advisors",
             "abogados y asesorías", "lawyers and accountants",
             ["lawyer", "accounting", "insurance_agency"],
             [("office", "^(lawyer|accountant|tax_advisor|notary|insurance)$")], True, False),
    Category("alojamientos", "Alojamientos", "Lodging", "hoteles y alojamientos", "hotels and lodging",
             ["lodging", "hotel", "hostel", "bed_and_breakfast", "guest_house"],
             [("tourism", "^(hotel|guest_house|hostel|apartment|motel)$")], True, False),
    Category("inmobiliarias", "Inmobiliarias", "Real estate", "inmobiliarias", "real estate agencies",
             ["real_estate_agency"], [("office", "^estate_agent$")], False, False),
    Category("veterinarios", "Veterinarios", "Veterinarians", "veterinarios", "veterinarians",
             ["veterinary_care"], [("amenity", "^veterinary$")], True, False),
    Category("autoescuelas", "Autoescuelas y academias", "Driving schools & academies",
             "autoescuelas y academias", "driving schools and academies",
             ["driving_school", "school"],
             [("amenity", "^(driving_school|language_school|music_school)$")], False, False),
]
NO_CATEGORY_LABEL = "Sin categoría"
OSM_TYPE_KEYS = ["amenity", "shop", "office", "craft", "leisure", "tourism", "healthcare"]
# --- end of fixed values ---------------------------------------------------------------------
