"""Text detectors: hidden instructions, canaries, tainted values, copied passages, skill rules."""
