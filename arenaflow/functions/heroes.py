"""Hero dimension and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HERO_NAME_PREFIX = "npc_dota_hero_"

# Hero id, display name, slug.
HEROES: list[tuple[int, str, str]] = [
    (1, "Anti-Mage", "antimage"),
    (2, "Axe", "axe"),
    (3, "Bane", "bane"),
    (4, "Bloodseeker", "bloodseeker"),
    (5, "Crystal Maiden", "crystal_maiden"),
    (6, "Drow Ranger", "drow_ranger"),
    (7, "Earthshaker", "earthshaker"),
    (8, "Juggernaut", "juggernaut"),
    (9, "Mirana", "mirana"),
    (10, "Morphling", "morphling"),
    (11, "Shadow Fiend", "nevermore"),
    (12, "Phantom Lancer", "phantom_lancer"),
    (13, "Puck", "puck"),
    (14, "Pudge", "pudge"),
    (15, "Razor", "razor"),
    (16, "Sand King", "sand_king"),
    (17, "Storm Spirit", "storm_spirit"),
    (18, "Sven", "sven"),
    (19, "Tiny", "tiny"),
    (20, "Vengeful Spirit", "vengefulspirit"),
    (21, "Windranger", "windrunner"),
    (22, "Zeus", "zuus"),
    (23, "Kunkka", "kunkka"),
    (25, "Lina", "lina"),
    (26, "Lion", "lion"),
    (27, "Shadow Shaman", "shadow_shaman"),
    (28, "Slardar", "slardar"),
    (29, "Tidehunter", "tidehunter"),
    (30, "Witch Doctor", "witch_doctor"),
    (31, "Lich", "lich"),
    (32, "Riki", "riki"),
    (33, "Enigma", "enigma"),
    (34, "Tinker", "tinker"),
    (35, "Sniper", "sniper"),
    (36, "Necrophos", "necrolyte"),
    (37, "Warlock", "warlock"),
    (38, "Beastmaster", "beastmaster"),
    (39, "Queen of Pain", "queenofpain"),
    (40, "Venomancer", "venomancer"),
    (41, "Faceless Void", "faceless_void"),
    (42, "Wraith King", "skeleton_king"),
    (43, "Death Prophet", "death_prophet"),
    (44, "Phantom Assassin", "phantom_assassin"),
    (45, "Pugna", "pugna"),
    (46, "Templar Assassin", "templar_assassin"),
    (47, "Viper", "viper"),
    (48, "Luna", "luna"),
    (49, "Dragon Knight", "dragon_knight"),
    (50, "Dazzle", "dazzle"),
    (51, "Clockwerk", "rattletrap"),
    (52, "Leshrac", "leshrac"),
    (53, "Nature's Prophet", "furion"),
    (54, "Lifestealer", "life_stealer"),
    (55, "Dark Seer", "dark_seer"),
    (56, "Clinkz", "clinkz"),
    (57, "Omniknight", "omniknight"),
    (58, "Enchantress", "enchantress"),
    (59, "Huskar", "huskar"),
    (60, "Night Stalker", "night_stalker"),
    (61, "Broodmother", "broodmother"),
    (62, "Bounty Hunter", "bounty_hunter"),
    (63, "Weaver", "weaver"),
    (64, "Jakiro", "jakiro"),
    (65, "Batrider", "batrider"),
    (66, "Chen", "chen"),
    (67, "Spectre", "spectre"),
    (68, "Ancient Apparition", "ancient_apparition"),
    (69, "Doom", "doom_bringer"),
    (70, "Ursa", "ursa"),
    (71, "Spirit Breaker", "spirit_breaker"),
    (72, "Gyrocopter", "gyrocopter"),
    (73, "Alchemist", "alchemist"),
    (74, "Invoker", "invoker"),
    (75, "Silencer", "silencer"),
    (76, "Outworld Devourer", "obsidian_destroyer"),
    (77, "Lycan", "lycan"),
    (78, "Brewmaster", "brewmaster"),
    (79, "Shadow Demon", "shadow_demon"),
    (80, "Lone Druid", "lone_druid"),
    (81, "Chaos Knight", "chaos_knight"),
    (82, "Meepo", "meepo"),
    (83, "Treant Protector", "treant"),
    (84, "Ogre Magi", "ogre_magi"),
    (85, "Undying", "undying"),
    (86, "Rubick", "rubick"),
    (87, "Disruptor", "disruptor"),
    (88, "Nyx Assassin", "nyx_assassin"),
    (89, "Naga Siren", "naga_siren"),
    (90, "Keeper of the Light", "keeper_of_the_light"),
    (91, "Io", "wisp"),
    (92, "Visage", "visage"),
    (93, "Slark", "slark"),
    (94, "Medusa", "medusa"),
    (95, "Troll Warlord", "troll_warlord"),
    (96, "Centaur Warrunner", "centaur"),
    (97, "Magnus", "magnataur"),
    (98, "Timbersaw", "shredder"),
    (99, "Bristleback", "bristleback"),
    (100, "Tusk", "tusk"),
    (101, "Skywrath Mage", "skywrath_mage"),
    (102, "Abaddon", "abaddon"),
    (103, "Elder Titan", "elder_titan"),
    (104, "Legion Commander", "legion_commander"),
    (105, "Techies", "techies"),
    (106, "Ember Spirit", "ember_spirit"),
    (107, "Earth Spirit", "earth_spirit"),
    (108, "Underlord", "abyssal_underlord"),
    (109, "Terrorblade", "terrorblade"),
    (110, "Phoenix", "phoenix"),
    (111, "Oracle", "oracle"),
    (112, "Winter Wyvern", "winter_wyvern"),
    (113, "Arc Warden", "arc_warden"),
    (114, "Monkey King", "monkey_king"),
    (119, "Dark Willow", "dark_willow"),
    (120, "Pangolier", "pangolier"),
    (121, "Grimstroke", "grimstroke"),
    (123, "Hoodwink", "hoodwink"),
    (126, "Void Spirit", "void_spirit"),
    (128, "Snapfire", "snapfire"),
    (129, "Mars", "mars"),
    (131, "Ringmaster", "ringmaster"),
    (135, "Dawnbreaker", "dawnbreaker"),
    (136, "Marci", "marci"),
    (137, "Primal Beast", "primal_beast"),
    (138, "Muerta", "muerta"),
    (145, "Kez", "kez"),
    (155, "Largo", "largo"),
]


def _lookup(pairs: list[tuple[Column, Column]], key: Column) -> Column:
    return F.element_at(F.create_map(*[part for pair in pairs for part in pair]), key)


def combat_log_name(hero_id: Column) -> Column:
    """Combat-log name of a hero id; NULL when the hero is unknown.

    The dimension is a literal map of constant size, so no join is needed.
    """
    pairs = [(F.lit(number), F.lit(HERO_NAME_PREFIX + slug)) for number, _, slug in HEROES]
    return _lookup(pairs, hero_id.cast("int"))


def pretty_name(raw_name: Column) -> Column:
    """Hero label, else the name without its prefix in title case."""
    pairs = [(F.lit(HERO_NAME_PREFIX + slug), F.lit(name)) for _, name, slug in HEROES]
    stripped = F.regexp_replace(raw_name, "^(?:npc_dota_hero_|npc_dota_|dota_|item_)", "")
    words = F.filter(F.split(stripped, "_"), lambda word: F.length(word) > 0)
    titled = F.array_join(F.transform(
        words, lambda word: F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))
    ), " ")
    return F.coalesce(_lookup(pairs, raw_name), F.nullif(titled, F.lit("")), raw_name)
