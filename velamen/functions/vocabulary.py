"""The types of spans, the word lists and the wording that results depend on."""

from __future__ import annotations

# Fixed values. Type, its label in pseudonyms, its priority in arbitration.
TYPES = [
    ("PASSPORT", "PASAPORTE", 105),
    ("DNI", "DNI", 100),
    ("NIE", "NIE", 100),
    ("IBAN", "IBAN", 100),
    ("EMAIL", "EMAIL", 90),
    ("CUSTOMER_ID", "CLIENTE", 85),
    ("PLATE", "MATRICULA", 80),
    ("PHONE", "TELEFONO", 70),
    ("ADDRESS", "DIRECCION", 60),
    ("POSTAL_CODE", "CP", 50),
    ("ORGANIZATION", "ORGANIZACION", 41),
    ("TERM", "TERMINO", 41),
    ("PERSON", "PERSONA", 40),
    ("CODIGO", "CODIGO", 40),
    ("TEXT", "TEXTO", 40),
]
LABEL = {t: label for t, label, _ in TYPES}
PRIORITY = {t: p for t, _, p in TYPES}
PROVENANCES = ["CHECKSUM_VALIDATED", "REGEX", "STRUCTURAL_CUE", "GAZETTEER", "PROPAGATED", "MANUAL"]

# Fixed values. Organizations that are known without rules.
ORGANIZATIONS = ["Banco Pastor", "Banco Popular"]

# Fixed values. Particles of a name that never identify by themselves.
NAME_PARTICLES = "de del la las los el y e da do dos van von san santa don dona sr sra srta sres".split()

# Fixed values. Words that begin an address field, in canonical form.
ADDRESS_WORDS = """
calle avenida avda av plaza plza pza paseo camino carretera ctra travesia ronda glorieta poligono urbanizacion
urb bloque portal escalera esc piso puerta apartado
rua carrer avinguda praza placa passeig travessera kalea etorbidea errepidea
""".split()

# Fixed values. Verbs of prose that follow a name, in canonical form.
PROSE_VERBS = ["suscribio", "abono"]

# Fixed values. Spanish given names.
GIVEN_NAMES = """
Maria Mª Lola Angela Natividad Carmen Ana Isabel Dolores Pilar Teresa Rosa Cristina Francisca Antonia Laura
Elena Marta Sara Raquel Patricia Silvia Beatriz Susana Julia Lucia Paula Andrea Alba Irene Nuria Eva Sonia
Monica Rocio Angeles Concepcion Mercedes Josefa Manuela Encarnacion Esther Alicia Yolanda Montserrat Amparo
Victoria Consuelo Nerea Claudia Sofia Daniela Noelia Vanesa Miriam Natalia Veronica Sandra Lorena Gema Olga
Ines Adriana Carla Antonio Manuel Jose Francisco David Juan Javier Daniel Carlos Miguel Rafael Pedro Angel
Alejandro Fernando Sergio Pablo Jorge Alberto Luis Alvaro Adrian Diego Raul Enrique Ramon Vicente Andres Oscar
Ruben Ignacio Roberto Jaime Eduardo Victor Joaquin Emilio Julio Gonzalo Mario Marcos Ivan Hector Guillermo
Cesar Salvador Gabriel Agustin Felipe Lorenzo Martin Nicolas Samuel Aitor Unai Xavier Jesus Santiago Tomas
Arturo Esteban Gregorio Hugo Ismael Lucas Mateo Rodrigo Sebastian
""".split()

# Fixed values. Capitalised words that are no names.
EXCLUDED_WORDS = """
de del la las el los y e i o u en a al con por para sin san santa da do dos das els les dels amb pel per un
una unos unas que se su sus es no si Juzgado Tribunal Audiencia Sala Real Decreto Ley Código Fundamentos
Antecedentes Hechos Derecho Ministerio Calle Avenida Plaza Provincia Comunidad Estado Gobierno Consejo Primera
Instancia Supremo Constitucional Fiscal Registro Notaría Banco Caja Sentencia Auto Acuerdo Resolución
Administración Justicia Civil Penal Social Constitución Artículo Capítulo Título Sección Disposición Anexo
Expediente Procedimiento Demandante Demandado Recurso Ayuntamiento Diputación Secretaría Delegación Dirección
General Nacional Municipal Oficial Boletín Colegio Universidad Hospital España Español Española Lunes Martes
Miércoles Jueves Viernes Sábado Enero Febrero Marzo Junio Agosto Septiembre Octubre Noviembre Diciembre
Documento Documentación Informe Acta Contrato Convenio Factura Importe Total Fecha Firma Nombre Apellido
Apellidos Número Objeto Asunto Notificación Domicilio Municipio Población Postal Servicios Servicio Sociedad
Empresa Entidad Parte Prueba Vista Otros Otras Segundo Segunda Tercero Tercera Cuarto Cuarta Quinto Quinta DNI
NIE NIF CIF
""".split()

# Fixed values. The controls of verification: name and wording of a finding.
FINDINGS = {
    "C1": ("C1-VALOR-LITERAL", "{what} sigue presente literalmente en la salida"),
    "C2": ("C2-VALOR-REFORMATEADO", "{what} reaparece en la salida con otro formato"),
    "C3": ("C3-TOKENS-DE-NOMBRE", "Un fragmento de persona permanece en el resultado; revise sus apariciones"),
    "C4-NONE": ("C4-COBERTURA-DE-SUSTITUCION", "{what} no tiene seudonimo asignado"),
    "C4": ("C4-COBERTURA-DE-SUSTITUCION", "La sustitución de {what} no aparece en la salida"),
    "C5": ("C5-SALIDA-NO-VACIA", "el Markdown generado esta vacio"),
    "OK": ("RESUMEN", "{what} sustituciones verificadas sin incidencias"),
}
FINDING_PERSON, FINDING_LINE = "persona", "{name} en línea {line}"

# Fixed values. Why an extracted text is not used; the numbers stand before, between or behind the parts.
GUARD_FEW = ("el documento no tiene capa de texto utilizable (", " caracteres). Comprueba que el PDF o la foto se lea con suficiente nitidez.")
GUARD_UNMAPPED = "% de caracteres no mapeables: el /ToUnicode del PDF es incorrecto y el texto extraido no es fiable."
GUARD_LETTERS = ("solo el ", "% del contenido son letras: el texto extraido no parece lenguaje natural.")
GUARD_USABLE, GUARD_BLANK, GUARD_UNRELIABLE = "texto utilizable", "El documento no contiene texto.", "Extraccion no fiable: "
