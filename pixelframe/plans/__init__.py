"""Plans that are fitted on one image and applied to others."""
