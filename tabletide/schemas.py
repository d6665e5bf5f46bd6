"""Column types and fixed values of the game-log tables."""

from __future__ import annotations

GAME_LOG = (
    "game_id long, seq long, ts timestamp, action string, player_id string, source_id string, delta long, "
    "effect_type string, seat string, starting_life long"
)
SETTINGS_LOG = "user_id long, ts timestamp, seq long, key string, value string"
#: Actions of a log, and those that need a player, a delta, an effect.
ACTIONS = ["new_game", "reset", "life", "cmd_damage", "set_effect", "clear_effect", "seat_move", "add_player", "remove_player", "gamba_tap", "gamba_done", "gamba_confirm",
    "gamba_skip", "pick_open", "pick_close", "random_start", "random_done", "random_confirm", "coin_flip", "die_roll"]
NEED_PLAYER, NEED_DELTA, NEED_EFFECT = ["life", "cmd_damage", "set_effect", "seat_move"], ["life", "cmd_damage"], ["set_effect", "clear_effect"]
DIAG_LINES = "device_id long, session_id long, line_no long, line string"

MOST_PLAYERS = 6
STARTING_LIFE = 40
#: The palette, one ARGB number for each of six slots.
PALETTE = [0xFF4A90D9, 0xFFE74C3C, 0xFF27AE60, 0xFF8E44AD, 0xFFE67E22, 0xFF16A085]
#: Seats and their quarter turns.
QUARTER_TURNS = {"rightSide": 3, "leftSide": 1, "bottomEdge": 0, "topEdge": 2}
#: Hold sensitivities in milliseconds.
HOLD_MS = {"short": 250, "medium": 400, "long": 600}
#: Dice that can be rolled.
DICE = [4, 6, 8, 10, 12, 20]
#: Bundled presets (id, name, starting life, players).
DEFAULT_PRESETS = [("commander", "Commander", 40, 4), ("standard", "Standard", 20, 2), ("solo", "Solo", 20, 1)]
#: Effects and the outline that each gives a player.
EFFECTS = [("monarch", 0xFFFFD700), ("initiative", None)]
#: Rotation limit of the diagnostic log in bytes, and rolls that a history shows.
ROTATION_LIMIT, HISTORY = 524288, 5
