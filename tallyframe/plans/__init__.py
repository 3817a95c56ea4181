"""Plans that compose sources into panels."""
