"""Policy bundles shipped with the package."""
