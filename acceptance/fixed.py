"""Word lists, weights and bounds of header recognition as the SQL side states them.

Fixed values: written out a second time, so that a wrong word or weight in the library turns a query red.
"""

# kinds emitted by the header scorer, in output order
SCORED_TYPES = ["date", "number", "text", "boolean", "select", "multiselect"]

# one list per input of the scorer, in input order; the eighth input is the length penalty
SIGNALS = {
    "date": ["fecha", "date", "dia", "mes", "año", "created", "updated"],
    "currency": ["monto", "importe", "total", "precio", "costo", "rate", "paid"],
    "identity": ["id", "uuid", "folio", "ticket", "reference", "rut", "dni", "cedula", "cédula", "documento"],
    "count": ["cantidad", "count", "qty", "units"],
    "location": ["direccion", "address", "city", "country", "postal"],
    "boolean": ["activo", "active", "enabled", "flag", "ok", "si", "no"],
    "text": ["cliente", "nombre", "descripcion", "comentario", "notas"],
}
FREE_LENGTH = 18
LENGTH_UNIT = 10

HIDDEN_WEIGHTS = [
    [1.2, 0.8, 0.4, 0.1, 0.2, -0.3, 0.1, -0.1],
    [0.5, 1.1, 0.6, 0.2, 0.3, -0.1, 0.0, -0.2],
    [0.1, 0.3, 1.0, 0.5, 0.2, 0.0, 0.0, -0.1],
    [0.2, 0.2, 0.1, 1.3, 0.1, 0.1, -0.2, 0.0],
    [0.1, 0.1, 0.0, 0.0, 1.1, 0.4, 0.2, -0.1],
]
HIDDEN_BIAS = [0.2, 0.1, 0.0, 0.0, 0.1]
OUTPUT_WEIGHTS = [
    [1.4, 0.3, 0.1, 0.1, 0.1],
    [0.1, 1.4, 0.2, 0.3, 0.0],
    [0.2, 0.2, 1.2, 0.1, 0.2],
    [0.1, 0.1, 0.1, 1.3, 0.0],
    [0.1, 0.2, 0.2, 0.0, 1.2],
    [0.3, 0.1, 0.3, 0.0, 0.1],
]
OUTPUT_BIAS = [0.0, 0.1, 0.0, 0.0, 0.1, 0.0]

PHOTO_WORDS = ["foto", "photo", "imagen", "image", "picture", "selfie", "url", "link"]
PHOTO_CONFIDENCE = 0.93
# "codigo postal" is left out: a token holds no blank, and "postal" is listed anyway
ADDRESS_WORDS = [
    "direccion", "dirección", "address", "calle", "street", "avenida", "avenue",
    "ciudad", "city", "state", "provincia", "postal", "zip",
]
ADDRESS_CONFIDENCE = 0.88

IDENTITY_KEYWORDS = [
    "rut", "dni", "documento", "identidad", "cedula", "cédula", "tecnico", "técnico", "technician",
]
POS_KEYWORDS = [
    "pos", "terminal", "tpv", "point of sale", "punto de venta", "pos number", "numero pos", "nro pos", "tid",
]
LOCATION_KEYWORDS = {
    "address": ["address", "dirección", "direccion", "domicilio", "ubicación", "ubicacion", "address line"],
    "latitude": ["lat", "latitud", "latitude"],
    "longitude": ["lng", "longitud", "longitude", "lon"],
}
# keyword score of a header: a point-of-sale word, two or more hits, one hit
POS_SCORE, MANY_SCORE, ONE_SCORE = 0.88, 0.76, 0.64
NO_POS_CONFIDENCE = 0.32
LEAST_GEO_CONFIDENCE = 0.35
TITLE_WITH_POS = "POS {{%s}} - Incidencia reportada"
TITLE_WITHOUT_POS = "Ticket sin POS - completa el número antes de asignar"

# target fields of an import: id, label, required, synonyms; earlier in PRIORITY wins a tie
FIELDS = [
    ("cliente", "Cliente", True,
     ["client", "cliente final", "razon social", "empresa", "compania", "customer", "account"]),
    ("direccion", "Dirección", True,
     ["address", "ubicacion", "ubicación", "domicilio", "calle", "dir", "localidad", "direccion cliente"]),
    ("fecha_visita", "Fecha de visita", True,
     ["fecha", "visit date", "fecha programada", "fecha agendada", "programacion", "fecha cita", "schedule date"]),
    ("tecnico", "Técnico asignado", False,
     ["tecnico", "technician", "ingeniero", "responsable", "operario", "asignado"]),
]
PRIORITY = ["direccion", "cliente", "fecha_visita", "tecnico"]

# template catalog and known fingerprints a fresh installation starts with
TEMPLATES = [
    ("template-historic", "v1", 0.82),
    ("template-mass", "v3", 0.68),
    ("template-adhoc", "v2", 0.57),
]
KNOWN_FINGERPRINTS = [("anchor-hash::formula-fp", "template-historic", "v1")]
REPEAT_PROMPTS = ["cliente", "proyecto"]
