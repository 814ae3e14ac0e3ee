"""Recall of re-parameterised benchmark items, planted in four languages."""

import random
from collections import Counter

from sievework.llm import decontamination

# Questions with slots: {a}, {b}, {c} numbers, {P}, {Q} persons, {C} a city, {u} a unit.
ITEMS = {
    "en": [
        "{P} bought {a} apples at the market and gave {b} of them to {Q}, who already had {c} apples at home. How many apples does {P} have left after the visit?",
        "A train leaves {C} at noon and travels {a} {u} before it stops for {b} minutes. How far has the train gone when it reaches the next station after {c} minutes?",
        "The baker needs {a} eggs for every {b} loaves of sweet bread. How many eggs are needed when {P} orders {c} loaves for the party in {C}?",
        "If {P} reads {a} pages on each day of the week and {Q} reads {b} pages more, how long will it take both of them to finish a book of {c} pages?",
        "A rectangular garden is {a} {u} long and {b} {u} wide. {P} wants to build a fence around the garden, so how much wire is needed in all?",
        "There were {a} passengers on the bus to {C} when {b} of them left and {c} new passengers came in. How many are on the bus now?",
    ],
    "fr": [
        "{P} a acheté {a} pommes au marché et en a donné {b} à {Q}, qui avait déjà {c} pommes à la maison. Combien de pommes lui reste-t-il après la visite?",
        "Un train quitte {C} à midi et parcourt {a} {u} avant de faire une pause de {b} minutes. Quelle distance a-t-il parcourue quand il arrive à la gare suivante?",
        "Le boulanger utilise {a} œufs pour {b} pains sucrés. Combien d'œufs faut-il quand {P} commande {c} pains pour la fête de {C}?",
        "Un jardin rectangulaire mesure {a} {u} de long et {b} {u} de large. {P} veut poser une clôture tout autour, quelle longueur de fil faut-il acheter en tout?",
        "Il y avait {a} voyageurs dans le bus pour {C} quand {b} sont descendus et {c} nouveaux voyageurs sont montés. Combien sont dans le bus maintenant?",
    ],
    "es": [
        "{P} compró {a} manzanas en el mercado y le dio {b} a {Q}, que ya tenía {c} manzanas en casa. ¿Cuántas manzanas le quedan después de la visita?",
        "Un tren sale de {C} al mediodía y recorre {a} {u} antes de hacer una pausa de {b} minutos. ¿Qué distancia ha recorrido cuando llega a la siguiente estación?",
        "El panadero usa {a} huevos para {b} panes dulces. ¿Cuántos huevos hacen falta cuando {P} pide {c} panes para la fiesta de {C}?",
        "Un jardín rectangular mide {a} {u} de largo y {b} {u} de ancho. {P} quiere poner una valla alrededor, ¿cuánto alambre tiene que comprar en total?",
        "Había {a} pasajeros en el autobús a {C} cuando {b} bajaron y {c} pasajeros nuevos subieron. ¿Cuántos hay ahora en el autobús?",
    ],
    "de": [
        "{P} kaufte {a} Äpfel auf dem Markt und gab {b} davon an {Q}, der schon {c} Äpfel zu Hause hatte. Wie viele Äpfel bleiben ihr nach dem Besuch noch übrig?",
        "Ein Zug verlässt {C} um zwölf Uhr und fährt {a} {u}, bevor er {b} Minuten lang hält. Wie weit ist er gefahren, wenn er den nächsten Bahnhof erreicht?",
        "Der Bäcker braucht {a} Eier für {b} süße Brote. Wie viele Eier werden gebraucht, wenn {P} für das Fest in {C} noch {c} Brote bestellt?",
        "Ein rechteckiger Garten ist {a} {u} lang und {b} {u} breit. {P} will ihn ganz einzäunen, also wie viel Draht muss dafür gekauft werden?",
        "Im Bus nach {C} saßen {a} Fahrgäste, als {b} von ihnen ausstiegen und {c} neue einstiegen. Wie viele sitzen jetzt noch im Bus?",
    ],
}
PEOPLE, CITIES, UNITS = ["Anna", "Boris", "Clara", "Dario", "Emil", "Frieda", "Gustav", "Helena"], ["Lisbon", "Oslo", "Vienna", "Porto", "Bergen", "Dublin"], ["km", "m", "miles", "meters"]


def fill(rng, text):
    people = rng.sample(PEOPLE, 2)
    a, b, c = rng.sample(range(3, 900), 3)
    return text.format(P=people[0], Q=people[1], C=rng.choice(CITIES), u=rng.choice(UNITS), a=a, b=b, c=c)


def planted(rng, copies=8):
    """Items (id, text), documents (id, text), and the pairs that must be found."""
    items, docs, want = [], [], set()
    for lang, texts in ITEMS.items():
        words = [w for t in texts for w in t.split() if w.isalpha() and w.islower()]
        say = lambda n: " ".join(rng.choice(words) for _ in range(n))  # noqa: B023, E731
        for text in texts:
            item = len(items)
            items.append((item, fill(rng, text), lang))
            for _ in range(copies):
                want.add((len(docs), item))
                docs.append((len(docs), f"{say(30).capitalize()}. {fill(rng, text)} {say(25).capitalize()}."))
        docs += [(len(docs) + i, say(120).capitalize() + ".") for i in range(40)]
    return items, docs, want


def test_recall_of_changed_questions(spark):
    items, docs, want = planted(random.Random(2))
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([i[:2] for i in items], "item_id long, text string"))
    got = {(r.id, r.item) for r in found.collect()}
    lang = {i: g for i, _, g in items}
    n, hit = Counter(lang[i] for _, i in want), Counter(lang[i] for _, i in got & want)
    recall = {g: hit[g] / n[g] for g in n}
    print("recall", recall, "others", len(got - want))
    assert len(got & want) / len(want) >= 0.9 and min(recall.values()) >= 0.8 and not got - want
